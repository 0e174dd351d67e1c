"""Every registered query against its SQL, as the driver compares them."""

import duckdb
import pytest

from quirefold.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 5) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    got = [{c: plain(r[c]) for c in df.columns} for r in df.collect()]
    assert got or name.startswith(("b02", "b05_policies", "f02", "t18"))
    if name in catalog.ORACLE_SQL:
        out = duck.execute(catalog.ORACLE_SQL[name])
        names = [x[0] for x in out.description]
        want = [{c: plain(v) for c, v in zip(names, r)} for r in out.fetchall()]
        key = lambda r: str(sorted(r.items()))
        assert sorted(map(key, got)) == sorted(map(key, want))
