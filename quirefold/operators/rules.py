"""States, retries, name rules and look-ups that combine several tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the code of a failure after the last retry of a provider.
EXHAUSTED = "provider_retry_exhausted"
_HAN = r"[㐀-鿿豈-﫿]"


def facts_state(chapters: DataFrame, failures: DataFrame, keys: Sequence[str], most: int, now: Column) -> DataFrame:
    """keys, state and detail of every chapter: processing, failed, ready or pending.

    chapters: enrichment_attempts, enrichment_retry_at, provider_attempts, provider_retry_at, ready, facts_count. A retry
    that is set and has attempts left means processing. A failure counts if its own kind of retry is used up; the latest
    one by (occurred_at, id) is the detail. A failed chapter with a retry still to come is pending, unless exhausted.
    """
    spent = lambda kind: (F.col(f"{kind}_attempts") >= most) & F.col(f"{kind}_retry_at").isNull()
    used = chapters.select(*keys, spent("provider").alias("_p"), spent("enrichment").alias("_e")).where("_p or _e")
    counts = F.when(F.col("error_code") == EXHAUSTED, F.col("_p")).otherwise(F.col("_e"))
    last = failures.join(used, list(keys)).where(counts).groupBy(*keys).agg(F.max(F.struct("occurred_at", "id", "error_code"))["error_code"].alias("detail"))
    trying = lambda kind: F.col(f"{kind}_retry_at").isNotNull() & (F.col(f"{kind}_attempts") < most)
    later = F.coalesce(F.least("provider_retry_at", "enrichment_retry_at") > now, F.lit(False)) & (F.col("detail") != EXHAUSTED)
    state = F.when(trying("enrichment") | trying("provider"), "processing").when(F.col("detail").isNotNull(), F.when(later, "pending").otherwise("failed"))
    state = state.when(F.col("ready") & F.col("facts_count").isNotNull(), "ready").otherwise("pending")
    return chapters.join(last, list(keys), "left").select(*keys, state.alias("state"), "detail")


def due(now: Column, most_enrichment: int, most_provider: int) -> Column:
    """Whether a chapter's retry is due: on the enrichment clock if no provider retry waits, or on the provider's clock."""
    enrichment = ~F.col("discarded") & (F.col("enrichment_retry_at") <= now) & (F.col("enrichment_attempts") < most_enrichment)
    enrichment = enrichment & F.col("provider_retry_at").isNull() & (F.col("provider_attempts") < most_provider)
    provider = (F.col("provider_retry_at") <= now) & (F.col("provider_attempts") < most_provider) & (~F.col("ready") | ~F.col("discarded"))
    return F.coalesce(enrichment, F.lit(False)) | F.coalesce(provider, F.lit(False))


def usable_source_name(term: Column, display: Column) -> Column:
    """A name of 1 to 40 characters without digits, and a rendering of at most 80 without Han characters."""
    return F.length(F.trim(term)).between(1, 40) & ~term.rlike("[0-9]") & (F.length(F.trim(display)) > 0) & (F.length(display) <= 80) & ~display.rlike(_HAN)


def discovered_names(names: Column, text: Column) -> Column:
    """Of an array of proposed names those that stand in the text, are trimmed, short and no sentence; each once, in order."""
    sound = lambda x: (x == F.trim(x)) & F.length(x).between(1, 80) & ~x.rlike(r"[\n\r!?。！？]") & ~x.endswith(".") & F.contains(text, x)
    return F.array_distinct(F.filter(names, sound))


def subject_kind(role: Column, existing: Column, listed: Column) -> Column:
    """Person roles are characters; else the kind on record, else the listed one."""
    return F.coalesce(F.when(role.isin("chinese_person", "foreign_person"), "character"), existing, listed)


def only_pending(reviews: DataFrame, parent: str, pending: Column) -> DataFrame:
    """Pending reviews whose parent has no other pending one."""
    waiting = reviews.where(pending)
    alone = waiting.groupBy(parent).agg(F.count("*").alias("_n")).where("_n = 1").select(parent)
    return waiting.join(alone, parent, "left_semi")


def aligned_positions(display: DataFrame, source: DataFrame, key: str, window: int = 4) -> DataFrame:
    """key, display_pos, source_pos: source paragraphs at most `window` from a displayed one's proportional position.

    display, source: key and pos, from 0. Half positions go to the even neighbour. The reachable positions are generated
    and joined by equality, so a long chapter costs 2 * window + 1 rows a paragraph.
    """
    sizes = source.groupBy(key).agg(F.count("*").alias("_s")).join(display.groupBy(key).agg(F.count("*").alias("_d")), key)
    centre = F.bround(F.col("display_pos") * (F.col("_s") / F.col("_d"))).cast("int")
    near = display.select(key, F.col("pos").cast("int").alias("display_pos")).join(sizes, key).select(key, "display_pos", F.explode(F.sequence(centre - window, centre + window)).alias("source_pos"))
    return near.join(source.select(key, F.col("pos").cast("int").alias("source_pos")), [key, "source_pos"]).select(key, "display_pos", "source_pos")


def repeated_stem(texts: DataFrame, key: str, width: int = 10, least: int = 4, share: float = 0.6) -> DataFrame:
    """Keys of texts of which at least `least` lines, and `share` of all that are not blank, begin with the same `width`
    characters. Shorter lines count as lines, but have no such beginning.
    """
    lines = texts.select(key, F.explode(F.split("text", "\n")).alias("line")).where("trim(line) != ''").withColumn("line", F.trim("line"))
    stems = lines.groupBy(key, F.when(F.length("line") >= width, F.left("line", F.lit(width))).alias("stem")).agg(F.count("*").alias("n"))
    counted = stems.groupBy(key).agg(F.max(F.when(F.col("stem").isNotNull(), F.col("n"))).alias("top"), F.sum("n").alias("lines"))
    return counted.where((F.col("top") >= least) & (F.col("top") * 10 >= F.lit(round(share * 10)) * F.col("lines")))


def as_of_attribute(facts: DataFrame, at: int, keys: Sequence[str]) -> DataFrame:
    """The attribute that holds at `at`: of the facts known and valid by then, and superseded by none of them, the latest.

    facts: id, supersedes (an id or null), source_chapter, valid_from, confidence.
    """
    known = facts.where((F.col("source_chapter") <= at) & (F.col("valid_from") <= at))
    replaced = known.where("supersedes is not null").select(F.col("supersedes").alias("id"))
    order = W.partitionBy(*keys).orderBy(F.desc("valid_from"), F.desc("source_chapter"), F.desc("confidence"), F.desc("id"))
    return known.join(replaced, "id", "left_anti").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
