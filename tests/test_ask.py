"""Questions of many readers against plain numpy, and table functions in SQL."""

import random

import numpy as np
from pyspark.sql import functions as F

from quirefold.functions import udtf
from quirefold.operators import ask, chunks, scan


def rows(n=300, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        v = [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]
        out.append((r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(9)]), i, v if r.random() > 0.05 else r.choice([None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan")] * 4, [1.0, 2.0]]), r.choice(["x", "x", None]), f"text {i} " * r.randint(1, 9)))
    return out


def sound(v):
    return bool(v) and None not in v and all(np.isfinite(v)) and any(v)


def test_nearest_for_all(spark):
    data = rows()
    df = spark.createDataFrame(data, "novel_id string, chapter_index int, id long, embedding array<double>, embedding_space string, text string")
    asked = df.where("id % 5 = 0").withColumn("question_id", F.concat(F.lit("q"), "id")).withColumn("at", F.col("chapter_index"))
    want = {}
    for novel, at, i, v, space, _ in data[::5]:
        if novel is None or at is None or not sound(v):
            continue
        a = np.array(v)
        near = sorted((round(1 - float(a @ np.array(w) / np.sqrt((a @ a) * (np.array(w) @ np.array(w)))), 9), j) for n, c, j, w, s, _ in data if n == novel and c is not None and c <= at and s == space and sound(w) and len(w) == len(v))
        want |= {(f"q{i}", k + 1): (j, d) for k, (d, j) in enumerate(near[:8])}
    for blocks in ({}, {"question_block": 7, "chunk_block": 11}):
        got = {(r.question_id, r["rank"]): (r.id, round(r.distance, 9) + 0.0) for r in ask.nearest_for_all(asked, df, **blocks).collect()}
        assert got == want and len(got) > 100
    assert ask.nearest_for_all(asked.where("false"), df).count() == 0 and ask.nearest_for_all(asked, df.where("false")).count() == 0


def test_ask(spark):
    df = spark.createDataFrame([("n", 1, 1, [1.0, 0.0], "a" * 50), ("n", 2, 2, [1.0, 0.1], "b" * 500), ("n", 3, 3, [1.0, 0.2], "c" * 20), ("n", 9, 4, [1.0, 0.0], "later"), ("m", 1, 5, [1.0, 0.0], "other")], "novel_id string, chapter_index int, id long, embedding array<double>, text string").withColumn("embedding_space", F.lit("s"))
    asked = spark.createDataFrame([("q1", "n", 3, [1.0, 0.0]), ("q2", "n", 0, [1.0, 0.0]), ("q3", None, 3, [1.0, 0.0]), ("q4", "n", 3, None)], "question_id string, novel_id string, at int, embedding array<double>").withColumn("embedding_space", F.lit("s"))
    got = {r.question_id: r for r in ask.ask(asked, df, max_chars=200).collect()}
    first, third = f"[chunk:1 ch:1]\n{'a' * 50}\n", f"[chunk:3 ch:3]\n{'c' * 20}\n"
    assert got["q1"].context == f"{first}\n{third}" and [tuple(s) for s in got["q1"].sources] == [(1, 1), (3, 3)] and got["q1"].answer is None
    assert all((got[q].context, got[q].sources, got[q].answer) == ("", [], ask.INSUFFICIENT) for q in ("q2", "q3", "q4"))


def test_table_functions_equal_frames(spark):
    udtf.register(spark)
    docs = spark.createDataFrame([(1, "n", "One. Two two. Three three three.\n\nFour!" * 5, "en"), (2, "n", "龙飞来了。😀龙", "zh"), (3, "m", "Fei met Long Fei, Feix.", "en"), (4, "m", None, "en"), (5, "o", "Fei", None), (6, "n", "", "en")], "doc_id long, novel_id string, text string, lang string")
    names = spark.createDataFrame([("n", "1", "龙飞"), ("n", "2", "龙"), ("m", "3", "Fei"), ("m", "4", "Long Fei"), ("m", "5", "Long Fei"), ("m", "6", "")], "novel_id string, alias_id string, surface string")
    got = spark.sql("SELECT d.doc_id, c.ordinal, c.start, c.end, c.chunk FROM {docs} d, LATERAL chunk_text(d.text, d.lang, 5) c", docs=docs).collect()
    want = chunks.chunk_text(docs, 5).select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.ordinal", "c.start", "c.end", "c.text").collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, want))
    sql = """SELECT * FROM scan_mentions(TABLE(SELECT novel_id, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS STRING) AS text, CAST(NULL AS STRING) AS lang, alias_id, surface FROM {names}
      UNION ALL SELECT novel_id, doc_id, text, lang, NULL, NULL FROM {docs}) PARTITION BY novel_id ORDER BY text IS NOT NULL)"""
    got = sorted(tuple(r)[1:] for r in spark.sql(sql, names=names, docs=docs).collect())
    want = []
    for novel in ("n", "m", "o"):
        spans = scan.scan_mentions(docs.where(F.col("novel_id") == novel), names.where(F.col("novel_id") == novel)).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
        want += [tuple(r) for r in spans.collect()]
    assert got == sorted(want) and len(got) == 5
