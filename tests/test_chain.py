"""The hash chain over whole logs."""

from pyspark.sql import functions as F

from quirefold.operators import hashing
from quirefold.plans import catalog

D = "/root/testdata/sf0.001"


def test_chain_of_many_batches(spark):
    log = spark.range(25_000).select(F.concat(F.lit("n"), F.col("id") % 2).alias("novel_id"), (25_000 - F.col("id")).alias("seq"), F.lit("s").alias("source_term"), F.lit(None).cast("string").alias("old_target"), F.col("id").cast("string").alias("new_target"), F.lit(1).alias("changed_at"))
    rows, last = sorted(hashing.chain(log).collect(), key=lambda r: (r.novel_id, r.seq)), {}
    for r in rows:
        assert r.prev_hash == last.get(r.novel_id)
        last[r.novel_id] = hashing.row_hash(r.prev_hash, r.novel_id, r.seq, r.source_term, r.old_target, r.new_target, r.changed_at)
        assert r.row_hash == last[r.novel_id]
    assert len(rows) == 25_000


def test_every_row_gets_a_hash(spark):
    assert catalog.QUERIES["e14_hash_chain"](spark, D).count() == spark.read.parquet(f"{D}/lineitem.parquet").count()
