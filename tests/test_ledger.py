"""Folds over arrays and changes of records on small cases."""

from pyspark.sql import functions as F

from quirefold.operators import ledger
from quirefold.streaming import claims


def test_leftmost_longest(spark):
    df = spark.createDataFrame([(1, [(3, 5), (0, 2), (0, 4), (4, 6), (9, 9)]), (2, [])], "id int, s array<struct<start:int,end:int>>")
    got = {r["id"]: [tuple(x) for x in r["k"]] for r in df.select("id", ledger.leftmost_longest(F.col("s")).alias("k")).collect()}
    assert got == {1: [(0, 4), (4, 6)], 2: []}


def test_batches(spark):
    df = spark.createDataFrame([(1, [3, 4, 5, 20, 1]), (2, [])], "id int, s array<int>")
    got = {r["id"]: r["b"] for r in df.select("id", ledger.batches(F.col("s"), 8).alias("b")).collect()}
    assert got == {1: [0, 0, 1, 2, 3], 2: []}


def test_fenced_beats_need_their_token(spark):
    beats = spark.createDataFrame([("a", 1.0, 50.0), ("a", 9.0, 90.0), ("b", 2.0, 95.0)], "key string, claimed_at double, ts double")
    leases = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 80.0)], "key string, claimed_at double")
    got = {r["key"]: (r["last"], r["live"]) for r in claims.fenced(beats, leases, 100.0, 45.0).collect()}
    assert got == {"a": (50.0, False), "b": (95.0, True), "c": (80.0, True)}


def test_longest_first_keeps_order(spark):
    df = spark.createDataFrame([(["b", "aa", "c", "aa", "dd"],)], "n array<string>")
    assert df.select(ledger.longest_first(F.col("n")).alias("n")).first()["n"] == ["aa", "dd", "b", "c"]
