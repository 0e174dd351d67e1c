"""Chains of links and walks over more rows than Spark's recursion takes, and over addresses that come twice."""

from pyspark.sql import functions as F

from quirefold.operators import versions
from quirefold.plans import catalog
from quirefold.sources import objects


def test_chains_of_more_rows_than_recursion_takes(spark):
    """Spark's recursive queries end with an error over a million rows."""
    n = 400_000
    links = spark.range(n).select("id", F.when(F.col("id") % 5 > 0, F.col("id") - 1).alias("to_id"))
    got = versions.resolved(links, 30).where("not cyclic and root = id - id % 5").count()
    assert got == n


def test_chains_by_length(spark):
    chain = [(i, i + 1) for i in range(40)] + [(40, None), (50, 51), (51, 50), (60, 61), (70, 70), (80, None), (90, 91), (91, None), (91, 92)]
    for most in (1, 2, 3, 29, 30, 31, 32, 40, 41, 64):
        got = {r.id: (r.root, r.cyclic) for r in versions.resolved(spark.createDataFrame(chain, "id long, to_id long"), most).collect()}
        assert all(got[i] == ((40, False) if 40 - i < most else (None, True)) for i in range(41))
        assert got[50] == got[51] == got[70] == (None, True) and got[80] == (80, False)
        assert got[60] == ((61, False) if most > 1 else (None, True)) and got[90] == ((92, False) if most > 2 else (None, True))


def _pages(spark, rows):
    return spark.createDataFrame(rows, "url string, text string, next_url string, continues boolean")


def test_walks_by_length(spark):
    pages = _pages(spark, [(f"u{i}", f"t{i}", f"u{i + 1}" if i < 20 else None, False) for i in range(21)] + [("a", "x", "b", False), ("b", "y", "a", False)])
    starts = spark.createDataFrame([(0, "u0"), (1, "a"), (2, "u18")], "walk long, url string")
    for most in (1, 2, 3, 7, 8, 9, 20, 21, 50):
        chapters, ends = objects.walk(pages, starts, most, 0)
        got = sorted((r.walk, r.chapter, r.text) for r in chapters.collect())
        want = [(0, i + 1, f"t{i}") for i in range(min(most, 21))] + [(1, i + 1, "xy"[i % 2]) for i in range(most)] + [(2, i + 1, f"t{18 + i}") for i in range(min(most, 3))]
        assert got == want
        assert {r.walk: r.reason for r in ends.collect()} == {0: "no_next_link" if most > 20 else "limit", 1: "limit", 2: "no_next_link" if most > 2 else "limit"}


def test_walks_over_addresses_that_come_twice(spark, tmp_path):
    """Pages 3 and 8 share an address; numbers 11 and 15 are missing. Walks are as their SQL has them."""
    import duckdb

    rows = [(i, f"http://h/{3 if i == 8 else i}") for i in range(23) if i not in (11, 15)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    sql = catalog.ORACLE_SQL["a11_walks"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(duckdb.sql(sql).fetchall())
    got = sorted((r.walk, r.chapter, r.source_url, r.n) for r in catalog.QUERIES["a11_walks"](spark, str(tmp_path)).collect())
    assert got == want
