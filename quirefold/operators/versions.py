"""Versions, overlays, look-ups and orders over keyed rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.operators.folds import folded


def current_version(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows of each key's greatest version, compared as it is typed (texts as text)."""
    top = df.groupBy(*keys).agg(F.max(version).alias("_top"))
    return df.join(top, list(keys)).filter(F.col(version) == F.col("_top")).drop("_top")


def without(df: DataFrame, overlay: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df but for the rows whose key the overlay names."""
    return df.join(overlay.select(*keys), list(keys), "left_anti")


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def with_latest(df: DataFrame, other: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """df with the latest row of each key in other, or nulls."""
    return df.join(latest(other, keys, *order), list(keys), "left")


def unstable_terms(df: DataFrame, term: str, target: str) -> DataFrame:
    """Terms with more than one target, and how many."""
    return df.groupBy(term).agg(F.countDistinct(target).alias("n_targets")).filter("n_targets > 1")


def overlay_first(saved: DataFrame, provisional: DataFrame, key: str, deleted: str = "deleted") -> DataFrame:
    """Saved rows win over provisional ones by key, tombstones too, which then go."""
    return saved.filter(~F.col(deleted)).unionByName(without(provisional, saved, [key]), allowMissingColumns=True)


def first_by(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    return latest(df, key, *order)


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that name one value only, with it."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("_n"), F.min(value).alias(value)).filter("_n = 1").drop("_n")


def gloss_as_of(changes: DataFrame, at: int) -> DataFrame:
    """The gloss of each term at a chapter: the last change by then, else what the first later change replaced."""
    before, after = F.col("changed_at") <= at, F.col("changed_at") > at
    last = F.max(F.when(before, F.struct("changed_at", "seq", "new_target")))["new_target"]
    next_ = F.min(F.when(after, F.struct("changed_at", "seq", "old_target")))["old_target"]
    return changes.groupBy("source_term").agg(F.coalesce(last, next_).alias("target"))


def islands(df: DataFrame, keys: Sequence[str], order: str, changes: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a new one begins where `changes` holds."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("_c", F.coalesce(changes, F.lit(True)).cast("int")).withColumn(name, F.sum("_c").over(w)).drop("_c")


def assemble(pages: DataFrame, keys: Sequence[str], order: str = "pos") -> DataFrame:
    """Continuation pages joined to chapters by blank lines; title and URL of the first page, next link of the last."""
    w = W.partitionBy(*keys).orderBy(order)
    numbered = islands(pages.withColumn("_begins", ~F.coalesce(F.lag("continues").over(w), F.lit(False))), keys, order, F.col("_begins"), "part")
    rows = numbered.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("p"), F.min_by("title", order).alias("title"), F.min_by("url", order).alias("url"), F.max_by("next_url", order).alias("next_url"), F.count("*").alias("n_pages"))
    return rows.withColumn("text", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")).drop("p")


def resolved(links: DataFrame, most: int = 64) -> DataFrame:
    """id, root and cyclic of links (id, to_id; null for none): where following them ends, or that it never does.

    A chain of `most` links or more counts as a cycle, and has no root. Each round joins what is known of the first steps to
    itself and so doubles them: rounds are the logarithm of `most`, and each holds one row a link.
    """
    walked = links.select("id", F.coalesce("to_id", "id").alias("at"), F.col("to_id").isNotNull().cast("int").alias("depth"), F.col("to_id").isNotNull().alias("on")).distinct()
    for _ in range(max(most - 1, 1).bit_length()):
        walked = walked.localCheckpoint()
        more = walked.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("depth").alias("_depth"), F.col("on").alias("_on"))
        both = walked.where("on").join(more, F.col("at") == F.col("_id"), "left")
        both = both.select("id", F.coalesce("_at", "at").alias("at"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("_on", F.lit(False)).alias("on"))
        walked = walked.where("not on").unionByName(both)
    ends = walked.groupBy("id").agg(F.max(F.struct("depth", "at")).alias("e"))
    return ends.select("id", F.when(F.col("e.depth") < most, F.col("e.at")).alias("root"), (F.col("e.depth") >= most).alias("cyclic"))


def greedy_pack(items: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, budget: int) -> DataFrame:
    """Items taken in order while they fit; one that would overflow is skipped, and later ones may still be taken.

    A key's items are read one after the other, and only those taken, which the budget bounds, are put together.
    """

    def step(state: dict, row: dict) -> bool:
        fits = state["used"] + row[size] <= budget
        state["used"] += row[size] if fits else 0
        return fits

    told = folded(items.select(*keys, *order, size, "item"), keys, order, lambda: {"used": 0}, step, "_fits", "boolean")
    some = F.when(F.col("_fits"), F.struct(*order, F.col("item")))
    packed = told.groupBy(*keys).agg(F.array_sort(F.collect_list(some)).alias("_taken"), F.coalesce(F.sum(F.when(F.col("_fits"), F.col(size))), F.lit(0)).cast("long").alias("used"))
    return packed.select(*keys, F.transform("_taken", lambda x: x["item"]).alias("taken"), "used")
