"""The operators that SQL can express, against their SQL, over whole tables."""

import duckdb
import pytest

from quirefold.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    out = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in out.description]
    want = [dict(zip(names, r, strict=True)) for r in out.fetchall()]
    df = queries.QUERIES[name](spark, D)
    got = [{c: r[c] for c in df.columns} for r in df.collect()]
    key = lambda r: str(sorted(r.items()))
    assert got and sorted(map(key, got)) == sorted(map(key, want))
