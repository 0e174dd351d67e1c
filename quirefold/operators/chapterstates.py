"""Chapters at work: retries and their clocks, pauses, the model of a stage, and what a reader is told."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Attempts of a stage and of a provider, first waits in seconds, and the longest wait of a stage.
MOST_STAGE, MOST_PROVIDER = 5, 5
STAGE_BASE, STAGE_CAP, PROVIDER_BASE = 300.0, 3600.0, 60.0
#: Milliseconds between looks at a chapter that waits, and at one at work.
POLL_PENDING, POLL_PROCESSING = 20000, 8000


def retries(failures: DataFrame) -> DataFrame:
    """failures (key, ts, event_id, kind, hint in seconds, manual) with attempt, wait (seconds, null if no retry is set) and
    outcome: scheduled, exhausted, or manual, where a failed retry by hand sets none.

    kind: stage, provider, or shared, a cool-down that another call earned. A stage's attempts double its wait up to the
    cap, and start the provider's count anew; a provider's wait is at least the hint; a shared cool-down waits for the hint and
    spends no attempt. Two running counts a key, no fold.
    """
    order = W.partitionBy("key").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    counted = failures.withColumn("_stages", F.sum((F.col("kind") == "stage").cast("int")).over(order))
    since = W.partitionBy("key", "_stages").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    counted = counted.withColumn("_calls", F.sum((F.col("kind") == "provider").cast("int")).over(since))
    hint, stage, shared = F.greatest(F.coalesce(F.col("hint").cast("double"), F.lit(0.0)), F.lit(0.0)), F.col("kind") == "stage", F.col("kind") == "shared"
    attempt = F.when(stage, F.least("_stages", F.lit(MOST_STAGE))).otherwise(F.col("_calls"))
    doubled = lambda base, n: F.lit(base) * F.pow(F.lit(2.0), F.greatest(n - 1, F.lit(0)))
    outcome = F.when(shared, "scheduled").when(stage, F.when(F.col("_stages") >= MOST_STAGE, "exhausted").when(F.coalesce("manual", F.lit(False)), "manual").otherwise("scheduled")).otherwise(F.when(F.col("_calls") >= MOST_PROVIDER, "exhausted").otherwise("scheduled"))
    wait = F.when(shared, hint).when(stage, F.least(doubled(STAGE_BASE, F.col("_stages")), F.lit(STAGE_CAP))).otherwise(F.greatest(doubled(PROVIDER_BASE, F.col("_calls")), hint))
    told = counted.withColumn("attempt", attempt.cast("int")).withColumn("outcome", outcome)
    return told.withColumn("wait", F.when(F.col("outcome") == "scheduled", wait)).drop("_stages", "_calls")


_RETRY = ("enrichment_retry_at", "provider_retry_at", "provider_retry_category")
_COUNTS = ("enrichment_attempts", "provider_retry_attempts")


def paused(chapters: DataFrame, chosen: Column, pause: bool) -> DataFrame:
    """chapters of which those chosen are paused or resumed, with nothing scheduled and no attempts counted; only where
    facts_count is missing, since a chapter that has its facts needs neither."""
    hit = F.coalesce(chosen, F.lit(False)) & F.col("facts_count").isNull()
    new = {"enrichment_discarded": F.lit(pause), **{c: F.lit(None) for c in _RETRY}, **{c: F.lit(0) for c in _COUNTS}}
    return chapters.select(*(F.when(hit, new[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in new else F.col(f.name) for f in chapters.schema.fields))


def refreshed(reviews: DataFrame, plans: DataFrame) -> DataFrame:
    """reviews (novel_id, source_term, status, first_seen_chapter, candidates, reason) whose choices are made anew by plans
    (the same keys, chapter, candidates, reason), while they are pending and of the chapter where the term was first seen."""
    new = plans.select("novel_id", "source_term", F.col("chapter").alias("_chapter"), F.col("candidates").alias("_candidates"), F.col("reason").alias("_reason"))
    hit = F.coalesce((F.col("status") == "pending") & (F.col("first_seen_chapter") == F.col("_chapter")), F.lit(False))
    joined = reviews.join(new, ["novel_id", "source_term"], "left").withColumn("_hit", hit)
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("candidates", "reason") else F.col(c) for c in reviews.columns))


def model_for(stage: Column, own: dict[str, Column], single: Column, config: dict[str, Column]) -> Column:
    """The model of a stage (translate, facts or another): a book's own for the stage, its only one, or the configured one.

    own and config: by translate, facts and extract; empty names count as none. A book with models by stage has no only one.
    Facts fall back on the configured model for facts, then on those for extracting.
    """
    some = lambda x: F.nullif(x, F.lit(""))
    by_stage = F.lit(False)
    for x in own.values():
        by_stage = by_stage | x.isNotNull()
    chain = lambda *xs: F.coalesce(*map(some, xs))
    split = F.when(stage == "translate", chain(own["translate"], config["translate"])).when(stage == "facts", chain(own["facts"], config["facts"], own["extract"], config["extract"])).otherwise(chain(own["extract"], config["extract"]))
    plain = F.when(stage == "translate", some(config["translate"])).when(stage == "facts", chain(config["facts"], config["extract"])).otherwise(some(config["extract"]))
    return F.when(by_stage, split).otherwise(F.coalesce(some(single), plain))


def features_label(graph_status: Column, status: Column, active: Column) -> Column:
    """label and tone of the reader's features of a chapter."""
    told = lambda label, tone: F.struct(F.lit(label).alias("label"), F.lit(tone).alias("tone"))
    return F.when(graph_status == "done", told("Ready", "live")).when(graph_status == "error", told("Needs attention", "bad")).when(status.isNull() | (status != "done"), told("After translation", "quiet")).when(active, told("Building", "live")).otherwise(told("Waiting", "warn"))


def facts_label(state: Column, discarded: Column, retry_at: Column, exhausted: Column, facts_count: Column) -> Column:
    """tone, text, retryable, terminal and poll (milliseconds) of a chapter's names and facts; text is null for failures and
    waits, which are worded by their cause."""
    told = lambda tone, text, retryable: F.struct(F.lit(tone).alias("tone"), text.cast("string").alias("text"), F.lit(retryable).alias("retryable"))
    ready = F.when(facts_count.isNull(), "Ready").otherwise(F.concat(F.lit("Ready · "), facts_count.cast("string"), F.when(facts_count == 1, " fact").otherwise(" facts"), F.lit(" for the wiki")))
    own = F.when(state.isNull(), told("quiet", F.lit("Checking…"), False)).when(discarded, told("quiet", F.lit("Paused"), True)).when(retry_at.isNotNull(), told("warn", F.lit(None), False)).when(exhausted | (state == "failed"), told("bad", F.lit(None), True))
    own = own.when(state == "processing", told("live", F.lit("Finding names and facts…"), False)).when(state != "ready", told("live", F.lit("Waiting to find names and facts…"), False)).otherwise(told("quiet", ready, False))
    terminal = F.coalesce(state.isNotNull() & retry_at.isNull() & (state.isin("ready", "failed") | F.coalesce(discarded, F.lit(False))), F.lit(False))
    poll = F.when(retry_at.isNull() & (state == "processing"), POLL_PROCESSING).otherwise(POLL_PENDING)
    return F.struct(own["tone"].alias("tone"), own["text"].alias("text"), own["retryable"].alias("retryable"), terminal.alias("terminal"), poll.alias("poll"))
