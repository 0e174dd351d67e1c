"""Helpers shared by the training-data operators."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Where this is true, Spark deletes a query's shuffle files when the query ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables saved in each open scratch.
_scopes: list[list[tuple[str, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Where the setting is absent a temporary folder is made once for the application, in local mode only: the tasks of a
    cluster would each write to a folder of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.getCheckpointDir():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quirefold-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def saved(df: DataFrame, label: str) -> DataFrame:
    """df, written as a table of the shared folder and read back.

    This cuts the lineage, survives the loss of executors, and gives the planner real sizes. The shuffle files of the write
    go once the table stands, so a chain of saved tables holds those of one step at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quirefold-{label}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append((label, path))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before or "false")
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Deletes the tables that are saved within at its end, but for those of the labels named: what is read after it.

    A table is deleted when all that is made of it is written, so no lost task needs it again.
    """
    scope: list[tuple[str, str]] = []
    _scopes.append(scope)
    try:
        yield
    finally:
        _scopes.pop()
        for label, path in scope:
            if label not in keep:
                discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder, on whatever file system that is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_group(f, **own):
    """f(rows, **own) in the form that applyInArrow of a grouping takes."""

    def call(rows: pa.Table) -> pa.Table:
        return f(rows, **own)

    return call


def on_groups(f, **own):
    """f(left, right, **own) in the form that applyInArrow of two cogrouped groupings takes."""

    def call(left: pa.Table, right: pa.Table) -> pa.Table:
        return f(left, right, **own)

    return call
