"""Records that only grow or change by rule: glossary terms, reviews, versions, jobs, counters and the folds over names."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert_outcome(existing: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """wanted (keys, target) with outcome: inserted if the key is missing or a tombstone, noop if it has that target, else conflict.

    existing: keys, target, deleted; one row for each key.
    """
    old = existing.select(*keys, F.col("target").alias("_target"), F.col("deleted").alias("_deleted"))
    free = F.coalesce(F.col("_deleted"), F.lit(True))
    outcome = F.when(free, "inserted").when(F.col("_target").eqNullSafe(F.col("target")), "noop").otherwise("conflict")
    return wanted.join(old, list(keys), "left").withColumn("outcome", outcome).drop("_target", "_deleted")


def insert_proven(existing: DataFrame, wanted: DataFrame, proof: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of wanted whose key stands in proof and not yet in existing, each key once."""
    return wanted.dropDuplicates(list(keys)).join(proof, list(keys), "left_semi").join(existing, list(keys), "left_anti")


def append_versions(versions: DataFrame, rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """rows with the version numbers that follow each key's greatest, in an order; keys without versions begin at 1."""
    last = versions.groupBy(*keys).agg(F.max("version").alias("_last"))
    n = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return rows.join(last, list(keys), "left").withColumn("version", (F.coalesce("_last", F.lit(0)) + n).cast("int")).drop("_last")


def selection_source(candidates: Column, selected: Column) -> Column:
    """offered if the selected target is one of the candidates, override if not."""
    return F.when(F.exists(candidates, lambda c: c == selected), "offered").otherwise("override")


def open_jobs(jobs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs of which no finished one has the same key, each once."""
    return jobs.dropDuplicates(list(keys)).join(done, list(keys), "left_anti")


def counted(parents: DataFrame, events: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """parents with the counter `name` raised by their events; other parents keep it."""
    n = events.groupBy(*keys).agg(F.count("*").alias("_n"))
    return parents.join(n, list(keys), "left").withColumn(name, F.col(name) + F.coalesce("_n", F.lit(0))).drop("_n")


def replace_partitions(existing: DataFrame, derived: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing with all rows of the keys in scope replaced by derived ones, which may be none."""
    return existing.join(scope, list(keys), "left_anti").unionByName(derived.join(scope, list(keys), "left_semi"))


def first_spelling(terms: DataFrame, target: str, locked: str, order: str) -> DataFrame:
    """Of the terms that share a target spelling the first, locked ones before pending ones."""
    rank = F.row_number().over(W.partitionBy(target).orderBy(F.col(locked).desc(), order))
    return terms.withColumn("_n", rank).where("_n = 1").drop("_n")


def longest_first(names: Column) -> Column:
    """An array's distinct names, longest first and of equal length in their order."""
    keyed = F.transform(F.array_distinct(names), lambda x, i: F.struct((-F.length(x)).alias("size"), i.alias("at"), x.alias("name")))
    return F.transform(F.array_sort(keyed), lambda x: x["name"])


def leftmost_longest(spans: Column) -> Column:
    """Spans (start, end) without overlaps: from the left, of those with one start the longest, each beginning at or after the last end."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"))))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda kept: F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0))
    taken = lambda kept, s: F.when((s["start"] >= last(kept)) & (-s["to"] > s["start"]), F.concat(kept, F.array(F.struct(s["start"].cast("int").alias("start"), (-s["to"]).cast("int").alias("end"))))).otherwise(kept)
    return F.aggregate(order, empty, taken)


def batches(sizes: Column, budget: int) -> Column:
    """The batch number, from 0, of each item of an array of sizes: a batch is closed by the item that would overflow it.

    An item above the budget gets a batch of its own.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("batch"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, size: Column) -> Column:
        new = (state["batch"] < 0) | (state["used"] + size > budget)
        batch = F.when(new, state["batch"] + 1).otherwise(state["batch"])
        return F.struct(F.when(new, size).otherwise(state["used"] + size).cast("long").alias("used"), batch.alias("batch"), F.concat(state["out"], F.array(batch)).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def observed(seconds: Column, ticks: Column) -> Column:
    """Whether a sample was watched: four fifths of the half-second ticks that its length asks for, one forgiven."""
    return ticks >= F.greatest(F.lit(1.0), seconds * 1.6 - 1)
