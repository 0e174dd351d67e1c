"""Nested views for readers: a chapter with its spans and their renderings, and the facts of wiki pages and timelines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import dereference, normalized_rendering
from quirefold.operators.versions import current_version, without

_CANDIDATES = "array<struct<target_term: string>>"


def _rendered(terms: DataFrame, glossary: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """terms (keys, novel_id, source_term, at) with what a reader at `at` knows of each: the confirmed spelling, the review."""
    known = glossary.where("not deleted").select("novel_id", "source_term", F.col("target_term").alias("_locked"), "constraint_class", "locked_at_chapter")
    seen = reviews.select("novel_id", "source_term", F.col("status").alias("_review"), F.col("term_role").alias("_role"), F.col("candidates").cast(_CANDIDATES).alias("_candidates"), "first_seen_chapter")
    on = lambda other, since: (F.col("t.novel_id") == F.col(f"{other}.novel_id")) & (F.col("t.source_term") == F.col(f"{other}.source_term")) & (F.col(f"{other}.{since}") <= F.col("t.at"))
    joined = terms.alias("t").join(known.alias("g"), on("g", "locked_at_chapter"), "left").join(seen.alias("r"), on("r", "first_seen_chapter"), "left")
    locked, pending = F.col("g.source_term").isNotNull(), F.col("_review") == "pending"
    first = F.get("_candidates", F.lit(0))["target_term"]
    status = F.when(locked, "locked").when(pending, "pending").otherwise("unlocked")
    role = F.coalesce("_role", F.when(F.col("constraint_class") == "character_name", "chinese_person").otherwise("semantic_term"))
    kept = F.slice(F.coalesce("_candidates", F.array().cast(_CANDIDATES)), 1, 1)
    told = F.struct(F.col("t.source_term").alias("source_term"), F.when(locked, F.col("_locked")).when(pending, first).alias("target_term"), status.alias("status"), role.alias("term_role"), kept.alias("candidates"))
    offered = F.coalesce(F.transform("_candidates", lambda c: c["target_term"]), F.array().cast("array<string>"))
    return joined.select(*(F.col(f"t.{c}").alias(c) for c in terms.columns), told.alias("rendering"), (F.col("_review").isNotNull() & (pending | locked)).alias("_reviewed"), F.concat(F.array(F.when(locked, F.col("_locked")).otherwise(first)), offered).alias("_spellings"))


def chapter_views(requests: DataFrame, chapters: DataFrame, spans: DataFrame, occurrences: DataFrame, named: DataFrame, glossary: DataFrame, reviews: DataFrame) -> DataFrame:
    """One nested row for each request of a chapter that its reader may see and that is done.

    requests: reader_id, novel_id, chapter_index, at. chapters: novel_id, chapter_index, status, translation_ready, raw_text,
    translated_text. spans: novel_id, chapter_index, mention_id, char_start, char_end. occurrences: novel_id, chapter_index,
    source_term, char_start, char_end. named: novel_id, chapter_index, source_term. glossary: novel_id, source_term,
    target_term, constraint_class, locked_at_chapter, deleted. reviews: novel_id, source_term, status, term_role, candidates
    (array with target_term), first_seen_chapter.

    Returns reader_id, novel_id, chapter_index, text, spans (mention_id, char_start, char_end, rendering, by start) and
    has_next, which does not depend on the reader's progress. A span has the rendering of the occurrence at its very
    offsets; without one, that of the only term, of those named in the chapter, one of whose spellings equals the span's
    text but for case and marks. Of several terms at the same offsets the last by name counts.

    Terms and spans travel without texts; a text moves once to its spans and once to its requests.
    """
    at = ["novel_id", "chapter_index"]
    keys = ["reader_id", *at]
    bodies = chapters.where("translation_ready or status = 'done'").select(*at, F.coalesce("translated_text", "raw_text").alias("text")).where("text is not null")
    allowed = requests.where(F.col("chapter_index") <= F.col("at")).select(*keys, "at")

    listed = spans.groupBy(*at).agg(F.collect_list(F.struct("char_start", "char_end", "mention_id")).alias("_spans"))
    inside = lambda s: (s["char_start"] >= 0) & (s["char_start"] < s["char_end"]) & (s["char_end"] <= F.length("text"))
    literal = lambda s: F.when(inside(s), F.nullif(normalized_rendering(F.substring(F.col("text"), s["char_start"] + 1, s["char_end"] - s["char_start"])), F.lit("")))
    placed = bodies.join(listed, at).select(*at, F.explode(F.transform("_spans", lambda s: F.struct(s["mention_id"].alias("mention_id"), s["char_start"].alias("char_start"), s["char_end"].alias("char_end"), literal(s).alias("key")))).alias("s")).select(*at, "s.*")

    offsets = [*keys, "char_start", "char_end"]
    exact = _rendered(allowed.join(occurrences.select(*at, "source_term", "char_start", "char_end"), at), glossary, reviews, offsets)
    exact = exact.groupBy(*offsets).agg(F.max_by("rendering", "source_term").alias("_exact"))
    spelled = _rendered(allowed.join(named.select(*at, "source_term").distinct(), at), glossary, reviews, keys).where("_reviewed")
    spelled = spelled.select(*keys, "source_term", "rendering", F.explode(F.array_distinct(F.transform("_spellings", normalized_rendering))).alias("key")).where("key <> ''")
    spelled = spelled.groupBy(*keys, "key").agg(F.countDistinct("source_term").alias("_n"), F.first("rendering").alias("_spelled")).where("_n = 1").drop("_n")
    shown = allowed.join(placed, at).join(exact, offsets, "left").join(spelled, [*keys, "key"], "left")
    span = F.struct("char_start", "char_end", "mention_id", F.coalesce("_exact", "_spelled").alias("rendering"))
    shown = shown.groupBy(*keys).agg(F.collect_list(span).alias("spans"))
    nothing = F.array().cast(shown.schema["spans"].dataType)
    order = lambda a, b: F.when(a["char_start"] != b["char_start"], a["char_start"] - b["char_start"]).when(a["mention_id"] < b["mention_id"], -1).when(a["mention_id"] > b["mention_id"], 1).otherwise(0).cast("int")
    after = chapters.select("novel_id", (F.col("chapter_index") - 1).alias("chapter_index")).distinct().withColumn("has_next", F.lit(True))
    whole = allowed.join(bodies, at).join(shown, keys, "left").join(after, at, "left")
    return whole.select(*keys, "text", F.array_sort(F.coalesce("spans", nothing), order).alias("spans"), F.coalesce("has_next", F.lit(False)).alias("has_next"))


def _named_facts(found: DataFrame, names: DataFrame) -> DataFrame:
    """found (reader_id, novel_id, at and facts) with markers as names and names, a map of the subjects that have one."""
    facts = found.withColumn("_fact", F.struct("reader_id", "novel_id", "chapter_index", "ordinal"))
    markers = F.regexp_extract_all("text", F.lit("⟦([^⟧]*)⟧"), F.lit(1))
    refs = facts.select("_fact", "novel_id", "at", F.explode(F.array_union("subjects", markers)).alias("subject"))
    known = names.select(F.col("novel_id").alias("_n"), F.col("subject").alias("_s"), "name", "kind", "since")
    refs = refs.join(known, (F.col("novel_id") == F.col("_n")) & (F.col("subject") == F.col("_s")) & (F.col("since") <= F.col("at")))
    refs = refs.groupBy("_fact", "subject").agg(F.max_by(F.struct("name", "kind"), F.struct("since", "name")).alias("_known"))
    refs = refs.groupBy("_fact").agg(F.map_from_entries(F.collect_list(F.struct("subject", "_known"))).alias("_names"))
    told = facts.join(refs, "_fact", "left").withColumn("_names", F.coalesce("_names", F.create_map().cast("map<string, struct<name: string, kind: string>>")))
    own = F.map_filter("_names", lambda k, _: F.array_contains("subjects", k))
    spelled = dereference(F.col("text"), F.transform_values("_names", lambda _, v: v["name"]))
    return told.select("reader_id", "novel_id", "at", "chapter_index", "ordinal", "category", spelled.alias("text"), "subjects", own.alias("names"))


def _visible(requests: DataFrame, facts: DataFrame, retractions: DataFrame) -> DataFrame:
    """Facts up to each request's chapter: of each chapter the newest prompt version that has categories, not retracted."""
    tagged = current_version(facts.where("category is not null"), ["novel_id", "chapter_index"], "prompt_version")
    kept = without(tagged, retractions, ["novel_id", "chapter_index", "prompt_version", "ordinal"])
    asked = requests.withColumnRenamed("novel_id", "_novel")
    return kept.join(asked, (F.col("novel_id") == F.col("_novel")) & (F.col("chapter_index") <= F.col("at"))).drop("_novel")


def page_facts(requests: DataFrame, facts: DataFrame, retractions: DataFrame, names: DataFrame) -> DataFrame:
    """The facts of the subjects asked for (reader_id, novel_id, subject, at), with names filled in; none for a subject whose
    name the reader does not know yet. A row a fact, to be read by chapter and ordinal.

    facts: novel_id, chapter_index, prompt_version, ordinal, category, text, subjects. retractions name facts by the first
    four. names: novel_id, subject, name, kind, since; the last one known counts. A marker of an unknown subject becomes "someone".
    """
    known = names.select(F.col("novel_id").alias("_n"), F.col("subject").alias("_s"), "since")
    met = requests.join(known, (F.col("novel_id") == F.col("_n")) & (F.col("subject") == F.col("_s")) & (F.col("since") <= F.col("at")), "left_semi")
    seen = _visible(met, facts, retractions).where(F.array_contains("subjects", F.col("subject")))
    return _named_facts(seen.withColumn("reader_id", F.struct("reader_id", "subject")), names).select(F.col("reader_id.reader_id").alias("reader_id"), "novel_id", F.col("reader_id.subject").alias("subject"), *_FACT)


_FACT = ("chapter_index", "ordinal", "category", "text", "subjects", "names")


def timeline(requests: DataFrame, facts: DataFrame, retractions: DataFrame, names: DataFrame) -> DataFrame:
    """The events that the readers (reader_id, novel_id, at) may know of, as page_facts gives facts."""
    return _named_facts(_visible(requests, facts.where("category is not null"), retractions).where("category = 'event'"), names).select("reader_id", "novel_id", *_FACT)


