"""The engine's domain, derived in the same way from the given tables by Spark and by SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NOVEL, AT = "n3", 30


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chapters(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chapters of the novel named by their source."""
    docs = table(spark, d, "documents")
    # numbered without their texts, which are joined by doc_id and so stay spread, however large a source is
    n = docs.select("doc_id", "source").withColumn("chapter_index", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).drop("source")
    return docs.join(n, "doc_id").select(F.col("source").alias("novel_id"), "chapter_index", "doc_id", "text", "lang", "n_chars")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as facts of chapters, in two prompt versions."""
    return table(spark, d, "conversations").select(
        F.concat(F.lit("n"), F.col("conv_id") % 7).alias("novel_id"), F.floor(F.col("conv_id") / 7).cast("int").alias("chapter_index"), F.concat(F.lit("facts-v"), 1 + F.col("turn") % 2).alias("prompt_version"),
        F.col("turn").cast("int").alias("ordinal"), "text", F.col("role").alias("category"), F.array(F.concat(F.lit("s"), F.length("text") % 13), F.concat(F.lit("t"), F.col("turn") % 5)).alias("subjects"), "conv_id",
    )


def retractions(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).where((F.col("conv_id") + F.col("ordinal")) % 11 == 0).select("novel_id", "chapter_index", "prompt_version", "ordinal")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("s", F.unix_timestamp("ts").cast("long"))


CTE = {
    "chapters": "chapters AS (SELECT source AS novel_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS chapter_index, doc_id, text, lang, n_chars FROM documents)",
    "facts": "facts AS (SELECT 'n' || (conv_id % 7) AS novel_id, CAST(conv_id // 7 AS INT) AS chapter_index, 'facts-v' || (1 + turn % 2) AS prompt_version, CAST(turn AS INT) AS ordinal, text, role AS category, ['s' || (length(text) % 13), 't' || (turn % 5)] AS subjects, conv_id FROM conversations)",
    "retractions": "retractions AS (SELECT novel_id, chapter_index, prompt_version, ordinal FROM facts WHERE (conv_id + ordinal) % 11 = 0)",
    "ev": "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)",
    "current": "top AS (SELECT novel_id, chapter_index, max(prompt_version) AS pv FROM facts GROUP BY 1, 2), current AS (SELECT f.* FROM facts f JOIN top t ON f.novel_id = t.novel_id AND f.chapter_index = t.chapter_index AND f.prompt_version = t.pv WHERE NOT EXISTS (SELECT 1 FROM retractions r WHERE r.novel_id = f.novel_id AND r.chapter_index = f.chapter_index AND r.prompt_version = f.prompt_version AND r.ordinal = f.ordinal))",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(CTE[n] for n in names) + " "
