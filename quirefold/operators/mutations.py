"""Changes of tables as functions from a table and a change to the new table."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def advance_progress(progress: DataFrame, moves: DataFrame, chapters: DataFrame) -> DataFrame:
    """Progress only rises, and only to chapters that are there."""
    readable = moves.join(chapters.select("novel_id", F.col("chapter_index").alias("current_chapter")), ["novel_id", "current_chapter"], "left_semi")
    both = progress.select("reader_id", "novel_id", "current_chapter").unionByName(readable.select("reader_id", "novel_id", "current_chapter"))
    return both.groupBy("reader_id", "novel_id").agg(F.max("current_chapter").alias("current_chapter"))


def insert_new(existing: DataFrame, rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """existing and the first row of each key in rows that it lacks."""
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return existing.unionByName(first.join(existing.select(*keys), list(keys), "left_anti").select(*existing.columns))


def ingest(existing: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Chapters new to a novel by source_url, where it is set, and then by raw_hash; of a batch's repeats the first arrival."""
    fresh = arrivals.join(existing.select("novel_id", "source_url"), ["novel_id", "source_url"], "left_anti").join(existing.select("novel_id", "raw_hash"), ["novel_id", "raw_hash"], "left_anti")
    named = fresh.where("source_url is not null").withColumn("_n", F.row_number().over(W.partitionBy("novel_id", "source_url").orderBy("arrival"))).filter("_n = 1").drop("_n")
    either = named.unionByName(fresh.where("source_url is null"))
    return either.withColumn("_n", F.row_number().over(W.partitionBy("novel_id", "raw_hash").orderBy("arrival"))).filter("_n = 1").drop("_n")


def put(existing: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows replace those of the same key."""
    return existing.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows.select(*existing.columns))


def correct_term(glossary: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections (source_term, new_target; null deletes) with a version above the novel's greatest; deletion keeps the target."""
    top = glossary.groupBy("novel_id").agg(F.coalesce(F.max("version"), F.lit(0)).alias("_top"))
    changed = glossary.join(corrections, ["novel_id", "source_term"], "left").join(top, "novel_id")
    return changed.select("novel_id", "source_term", F.coalesce("new_target", "target_term").alias("target_term"), F.when(F.col("is_change"), F.col("_top") + 1).otherwise(F.col("version")).alias("version"), F.when(F.col("is_change"), F.col("new_target").isNull()).otherwise(F.col("deleted")).alias("deleted"))


def cascade(tables: dict[str, DataFrame], deleted: DataFrame, key: str = "novel_id") -> dict[str, DataFrame]:
    """All tables without the rows of deleted parents."""
    return {name: df.join(deleted.select(key), key, "left_anti") for name, df in tables.items()}


def collapse_progress(progress: DataFrame) -> DataFrame:
    """One row for each novel: the greatest chapter, of equal ones the first row."""
    w = W.partitionBy("novel_id").orderBy(F.desc("current_chapter"), "row")
    return progress.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
