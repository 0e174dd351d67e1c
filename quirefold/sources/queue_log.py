"""Queues as logs of batches in a folder, written once each, and previews of unfinished output.

A batch's rows are written under its number and replace what an earlier try left there; then a marker says that they are
whole. Readers go by the markers, so a batch that was cut off is not seen, and one that is written again counts once. All
of it is Spark's readers and writers, on any file system.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_MARK = "batch bigint, n bigint"


def push(rows: DataFrame, base: str, batch: int) -> None:
    """Appends rows to the log as one batch; the same batch again replaces it."""
    rows.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")
    n = rows.sparkSession.read.parquet(f"{base}/rows/batch={batch}").count()
    rows.sparkSession.createDataFrame([(batch, n)], _MARK).coalesce(1).write.mode("overwrite").json(f"{base}/marks/{batch:012d}")


def sink(base: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch of a stream becomes a batch of the log, once, however often it is tried."""
    return lambda rows, batch: push(rows, base, batch)


def _marks(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(_MARK).json(f"{base}/marks/*")


def read(spark: SparkSession, base: str, batches: DataFrame | None = None) -> DataFrame:
    """The rows of all whole batches, or of those given, with their batch."""
    marks = _marks(spark, base) if batches is None else batches
    rows = spark.read.option("basePath", f"{base}/rows").parquet(f"{base}/rows")
    return rows.withColumn("batch", F.col("batch").cast("bigint")).join(marks.select("batch").distinct(), "batch", "left_semi")


def consume(spark: SparkSession, base: str, work: Callable[[DataFrame, int], None], checkpoint: str):
    """A streaming query that gives new batches of the log to `work`, with a number under which a retry comes again."""
    marks = spark.readStream.schema(_MARK).option("recursiveFileLookup", "true").json(f"{base}/marks")

    def step(found: DataFrame, batch: int) -> None:
        if not found.isEmpty():
            work(read(spark, base, found), batch)

    return marks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def listed(log: DataFrame) -> DataFrame:
    """The elements of each queue after its log (queue, seq, op, value): seq, value and place, from 0 at the front.

    op: rpush at the end, lpush at the front, lrem takes out all elements then in the queue that equal the value.
    """
    removed = log.where("op = 'lrem'").groupBy("queue", "value").agg(F.max("seq").alias("_gone"))
    pushed = log.where("op IN ('rpush', 'lpush')").join(removed, ["queue", "value"], "left").where("_gone IS NULL OR seq > _gone")
    order = W.partitionBy("queue").orderBy(F.when(F.col("op") == "lpush", -F.col("seq")).otherwise(F.col("seq")))
    return pushed.select("queue", "seq", "value", (F.row_number().over(order) - 1).cast("int").alias("place"))


def preview_rows(parts: DataFrame, interval: float = 0.5) -> DataFrame:
    """The last text of each key in each interval of seconds: what is worth writing of parts (key, ts in seconds, event_id, text)."""
    tick = F.floor(F.col("ts") / interval).cast("bigint")
    last = F.max_by(F.struct("ts", "event_id", "text"), F.struct("ts", "event_id"))
    return parts.groupBy("key", tick.alias("tick")).agg(last.alias("l")).select("key", "tick", "l.ts", "l.event_id", "l.text")


def preview_sink(base: str, interval: float = 0.5) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes at most one row a key and interval, also over batches: the first batch that has any of an
    interval decides its row. A retry of a batch writes the same."""

    def write(parts: DataFrame, batch: int) -> None:
        spark, rows = parts.sparkSession, preview_rows(parts, interval)
        if batch:
            before = read(spark, base).where(F.col("batch") < batch).select("key", "tick")
            rows = rows.join(before, ["key", "tick"], "left_anti")
        push(rows, base, batch)

    return write


def previews(spark: SparkSession, base: str, now: float, ttl: float = 900.0) -> DataFrame:
    """The present preview of each key: the last text written, unless that is `ttl` seconds ago or more."""
    rows = read(spark, base).groupBy("key").agg(F.max_by(F.struct("ts", "text"), F.struct("ts", "event_id")).alias("l"))
    return rows.where(F.lit(now) - F.col("l.ts") < ttl).select("key", "l.ts", "l.text")
