import time

from pyspark.sql import functions as F

from quirefold.llm.common import saved


def _shuffles(spark):
    """The shuffle files that the application holds on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for x in (files.apply(i).getName() for i in range(files.size())) if x.startswith("shuffle_") and x.endswith(".data")}


def test_shuffles_go_with_the_write(spark):
    before, setting = _shuffles(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    table = saved(spark.range(100_000).groupBy((F.col("id") % 5_000).alias("k")).agg(F.count("*").alias("n")), "counts")
    for _ in range(50):  # files are deleted beside the driver's work
        if not _shuffles(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffles(spark) - before
    assert (table.count(), table.agg(F.sum("n")).first()[0]) == (5_000, 100_000)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
