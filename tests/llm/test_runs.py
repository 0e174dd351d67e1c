"""Operator 13 against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm.periodic_runs import Extensions, periodic_runs
from quirefold.llm.queries import with_periods
from tests.llm.fixtures import documents, frame, unlike


def brute(words, least=24, times=3):
    """Every stretch that keeps a period and cannot be extended, by comparing all words, with its smallest period."""
    n, found = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    runs = sorted((s, e - s, p) for (s, e), p in found.items())
    runs.sort(key=lambda x: (x[0], x[2]))
    gone = {k for s, n_, p in runs for k in range(s + p, s + n_)}
    return runs, " ".join(w for k, w in enumerate(words) if k not in gone)


def texts():
    r = random.Random(5)
    out = [t for _, t in documents()]
    for _ in range(120):
        words = []
        for _ in range(r.randint(1, 5)):
            piece = [r.choice("abc") for _ in range(r.randint(1, 12))]
            words += r.choice([piece, piece * r.randint(2, 9), [r.choice("abcdefgh") for _ in range(r.randint(0, 30))]])
        out.append(" ".join(words))
    out += ["x " * 3000, "ä ö " * 40 + "ü", "a b " * 12, "a b " * 11 + "a", ("a " * 30 + "b ") * 5, "one\x1etwo three " * 30]
    return out


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (12, 4)])
def test_runs_equal_brute_force(spark, least, times):
    rows = texts()
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in periodic_runs(df, least, times).collect()}
    assert len(got) == len(rows)
    for k, t in enumerate(rows):
        runs, collapsed = brute([w.decode() for w in (t or "").encode().split()], least, times)
        assert [tuple(x) for x in got[k].runs] == runs, t
        assert got[k].collapsed == collapsed
    assert sum(bool(r.runs) for r in got.values()) > 40


def test_odd_rows(spark):
    found = periodic_runs(frame(spark).withColumn("runs", F.lit(1)))
    assert found.count() == len(documents()) and found.columns[-2:] == ["runs", "collapsed"]
    assert all(r.runs == [] and r.collapsed == "" for r in found.where("trim(coalesce(text, '')) = ''").collect())
    assert periodic_runs(unlike(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(unlike(spark), times=2)


def test_long_text(spark):
    r = random.Random(2)
    piece = " ".join(r.choice("abcdefghij") + str(r.randint(0, 50)) for _ in range(70_000))
    df = spark.createDataFrame([(1, f"{piece} {piece} {piece} z"), (2, "y " * 300_000)], "doc_id long, text string")
    one, two = (sorted(map(tuple, r.runs)) for r in periodic_runs(df).orderBy("doc_id").collect())
    assert one == [(0, 210_000, 70_000)] and two == [(0, 300_000, 1)]


def test_extensions():
    r = np.random.Generator(np.random.PCG64(1))
    for _ in range(60):
        s = np.concatenate([r.integers(0, r.integers(1, 4), r.integers(2, 60)), [9]])
        x, (i, j) = Extensions(s), np.triu_indices(len(s), 1)
        want = [next(k for k in range(len(s)) if s[a + k] != s[b + k]) for a, b in zip(i, j, strict=True)]
        assert x.common(i, j).tolist() == want and x.common(j, i).tolist() == want


def test_planted_periods(spark):
    import zlib

    rows = [(k, " ".join(f"w{j}" for j in range(1 + k % 60))) for k in range(300)] + [(10**9, ""), (None, "a b"), (300, None)]
    got = {r.doc_id: r.text for r in with_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and got[None] == "a b"
    changed = 0
    for k, t in rows[:300]:
        h, w = zlib.crc32(str(k).encode()), t.split()
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
            changed += 1
        assert got[k] == (" ".join(w) if h % 10 == 0 else t)
    assert changed > 10
