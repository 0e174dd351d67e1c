"""Bodies of chapters as objects under keys, JSON lines, and walks over pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """key and text: every file under path as one UTF-8 text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("key"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row for each line that is not blank."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def body_key(novel: str = "novel_id", chapter: str = "chapter_index", kind: str = "raw"):
    """The key of a chapter's body; a translation's also holds the hash of its text, so other texts never share it."""
    own = F.concat(F.lit("raw.txt")) if kind == "raw" else F.concat(F.sha2("text", 256), F.lit(".txt"))
    return F.concat_ws("/", F.lit("novels"), novel, F.lit("chapters" if kind == "raw" else "translated"), F.col(chapter).cast("string"), own)


def write_bodies(rows: DataFrame, base: str) -> None:
    """Writes bodies (novel_id, chapter_index, text) under their novel and chapter; chapters written again are replaced,
    others stay.
    """
    told = rows.withColumn("key", body_key())
    told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("novel_id", "chapter_index").parquet(base)


def read_bodies(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema("text string, key string, novel_id string, chapter_index int").parquet(base)


def walk(pages: DataFrame, starts: DataFrame, most: int = 1000, floor: int = 400) -> tuple[DataFrame, DataFrame]:
    """Chapters (walk, chapter, source_url, text) and why each walk ended (walk, reason).

    pages: url, text, next_url, continues; starts: walk, url. A walk follows next_url. It ends where a page is missing
    (not_found), where a text of under `floor` bytes comes again in the walk (duplicate_content), behind a page without
    next link (no_next_link), or after `most` pages (limit). Pages that continue make one chapter with those after them; a
    chapter that never ends is not given.

    Of pages with one url that of the smallest next_url counts, then by continues and text. Only addresses are followed, twice
    as many steps each round, so rounds are the logarithm of the longest walk; texts are joined once, when all places are known.
    """
    rest = [c for c in pages.columns if c != "url"]
    pages = pages.groupBy("url").agg(F.min_by(F.struct(*rest), F.struct("next_url", "continues", F.xxhash64("text"))).alias("_p")).select("url", "_p.*")
    jumps = pages.where("next_url is not null").select(F.col("url").alias("_from"), F.col("next_url").alias("_to"))
    steps, size = starts.select("walk", F.lit(1).alias("step"), "url"), 1
    while size < most:
        jumps, steps = jumps.localCheckpoint(), steps.localCheckpoint()
        later = steps.where(F.col("step") + size <= most).join(jumps, F.col("url") == F.col("_from")).select("walk", (F.col("step") + size).alias("step"), F.col("_to").alias("url"))
        later = later.localCheckpoint()
        if later.isEmpty():
            break
        steps, size = steps.unionByName(later), 2 * size
        jumps = jumps.join(jumps.select(F.col("_from").alias("_to"), F.col("_to").alias("_next")), "_to").select("_from", F.col("_next").alias("_to"))
    met = steps.join(pages.withColumnRenamed("url", "_url"), F.col("url") == F.col("_url"), "left")
    by_text = W.partitionBy("walk", F.sha2("text", 256)).orderBy("step")
    again = (F.octet_length("text") < floor) & (F.row_number().over(by_text) > 1)
    met = met.withColumn("_end", F.when(F.col("_url").isNull(), "not_found").when(again, "duplicate_content"))
    order = W.partitionBy("walk").orderBy("step")
    first_end = F.min(F.when(F.col("_end").isNotNull(), F.col("step"))).over(W.partitionBy("walk"))
    met = met.withColumn("_stop", first_end)
    kept = met.where(F.col("_stop").isNull() | (F.col("step") < F.col("_stop")))
    closed = F.coalesce(F.sum((~F.col("continues")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = kept.withColumn("chapter", (closed + 1).cast("int"))
    chapters = parts.groupBy("walk", "chapter").agg(F.sort_array(F.collect_list(F.struct("step", "url", "text"))).alias("p"), F.bool_or(~F.col("continues")).alias("whole")).where("whole")
    chapters = chapters.select("walk", "chapter", F.get("p", F.lit(0))["url"].alias("source_url"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))
    last = met.groupBy("walk").agg(F.min(F.when(F.col("_end").isNotNull(), F.struct("step", "_end"))).alias("e"), F.max(F.struct("step", "next_url")).alias("l"))
    reason = F.coalesce(F.col("e._end"), F.when(F.col("l.next_url").isNull(), "no_next_link").otherwise("limit"))
    return chapters, last.select("walk", reason.alias("reason"))
