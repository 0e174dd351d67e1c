"""Operators 2 and 9 against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirefold.llm.embedding_dedup import embedding_dedup
from quirefold.llm.topk import exact_top_k
from tests.llm.test_text_dedup import components


def vectors(n=400, dim=16, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        v = [r.gauss(0, 1) for _ in range(dim)]
        if rows and r.random() < 0.4:
            base = rows[r.randrange(min(len(rows), 40))][1]
            v = [x + r.gauss(0, 0.12) for x in base] if r.random() < 0.7 else list(base)
        rows.append((i, v))
    return rows + [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [None] * dim), (n + 4, [float("nan")] * dim), (n + 5, [float("inf")] * dim), (n + 6, [1.0, 2.0]), (n + 100 - n % 100, [2.0, 4.0]), (None, [1.0] * dim), (n + 8, [1e300] * dim), rows[5]]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, pass string, block int")


def sound(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_top_k(spark):
    rows = [x for x in vectors() if x[0] != 408]
    got = [tuple(x) for x in exact_top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, query_block=3, block=64).select("query_id", "rank", "vec_id", "score").collect()]
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and sound(v)]
    want = []
    for q, a in {i: v for i, v in ints if i % 100 == 0}.items():
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q and len(a) == len(b))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    assert sorted(got) == sorted(want)
    assert exact_top_k(frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_large_scores_are_exact(spark):
    big = float(1 << 50)  # 2^60 once scaled: products with small whole numbers pass 2^61
    rows = [(0, [3.0 / 1024, 1.0 / 1024])] + [(i, [big * 2, float(i)]) for i in range(1, 6)] + [(6, [-big * 2, 0.0]), (7, [big * 2, 5.5])]
    got = [(r["rank"], r.vec_id, r.score) for r in exact_top_k(frame(spark, rows), F.col("vec_id") == 0).collect()]
    top = 3 * (1 << 61)
    assert sorted(got) == [(1, 7, top + 5632), (2, 5, top + 5120), (3, 4, top + 4096), (4, 3, top + 3072), (5, 2, top + 2048), (6, 1, top + 1024), (7, 6, -top)]
    rows = [(0, [1e300, -1e300]), (1, [1e300, 0.0]), (2, [-1e300, 5.0]), (3, [1e308, 1e308])]
    got = [(r["rank"], r.vec_id, r.score) for r in exact_top_k(frame(spark, rows), F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(1, 1, 2**63 - 1), (2, 3, 0), (3, 2, -(2**63))]


def test_rows_that_share_the_id_of_a_query(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (0, [1.0, 0.0]), (1, [3.0, 0.0])]
    got = [(r["rank"], r.vec_id, r.score >> 20) for r in exact_top_k(frame(spark, rows), F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(1, 1, 3), (2, 0, 2), (3, 0, 1)]


def test_embedding_dedup(spark):
    rows = vectors(seed=3)
    rows[-1] = (9999, rows[-1][1])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(frame(spark, rows), passes=8, width=64, block=100).collect()}
    ok = [(i, v) for i, v in rows if i is not None and sound(v) and any(v)]
    links = defaultdict(set)
    for i, a in ok:
        for j, b in ok:
            if i < j and len(a) == len(b):
                na, nb = max(map(abs, a)), max(map(abs, b))
                a1, b1 = [x / na for x in a], [x / nb for x in b]
                if sum(x * y for x, y in zip(a1, b1)) / math.sqrt(sum(x * x for x in a1) * sum(x * x for x in b1)) >= 0.95:
                    links[i].add(j)
                    links[j].add(i)
    parts = components([i for i, _ in rows if i is not None], [(a, b) for a in links for b in links[a]])
    assert all(got[i][0] <= len(links[i]) for i in got if i is not None)
    assert sum(x[0] for x in got.values()) >= 0.95 * sum(map(len, links.values())) > 0
    assert sum(got[i][1] == parts[i] for i in parts) >= 0.98 * len(parts)
    assert all(k == (c == i) for i, (_, c, k) in got.items() if i is not None)
    assert embedding_dedup(frame(spark, [])).count() == 0


def numpy_links(t):
    """n_links of every row, in order, over all pairs."""
    v = np.array([x for _, x in t], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return np.concatenate([(v[k : k + 512] @ v.T >= 0.95).sum(axis=1) - 1 for k in range(0, len(v), 512)])


@pytest.mark.parametrize("table", ["members 2000", "members 20000", "several"])
def test_recall(spark, table):
    r = np.random.default_rng(5)
    # near copies of one centre, or of several, among others
    n = 20_000 if table == "members 20000" else 2000
    centres = r.standard_normal((1 if "members" in table else 40, 64))
    near = centres[np.arange(n) % len(centres)] + r.standard_normal((n, 64)) * r.uniform(0.05, 0.28, (n, 1))
    rows = list(enumerate(np.concatenate([near, r.standard_normal((2000, 64))]).astype(np.float32).tolist()))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": [i for i, _ in rows], "embedding": [v for _, v in rows]}), "vec_id long, embedding array<float>")
    got = {x.vec_id: x.n_links for x in embedding_dedup(df).collect()}
    want = numpy_links(rows)
    assert all(got[i] <= w for (i, _), w in zip(rows, want, strict=True))
    assert sum(got.values()) >= 0.97 * want.sum() > 0
    outside = want < np.quantile(want, 0.9)  # apart from the largest groups
    assert sum(got[rows[k][0]] for k in np.flatnonzero(outside)) >= 0.97 * want[outside].sum()
