"""Operators 1, 3 and 8 and the pipeline's near-duplicates against brute force."""

import hashlib
import re
from collections import defaultdict

import pytest
import xxhash

from quirefold.llm.components import connected_components
from quirefold.llm.line_dedup import line_dedup
from quirefold.llm.simhash_dedup import drop_near_duplicates, near_duplicates, near_pairs, simhash_components
from quirefold.llm.substring_dedup import substring_dedup
from tests.llm.fixtures import documents, frame, unlike

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def components(nodes, edges):
    parent = {x: x for x in nodes}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {x: find(parent, x) for x in nodes}


def sf_rows(spark, sf="sf0.001"):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]


def brute_substring(rows, n=13):
    least = {}
    for i, t in rows:
        if i is not None:
            w = WORD.findall(t or "")
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - n + 1):
                if least[tuple(w[k : k + n])] < i:
                    gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", ["odd", "sf0.01"])
def test_substring_dedup(spark, rows):
    rows = documents() if rows == "odd" else sf_rows(spark, rows)
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_substring(rows)
    assert any(x[2] for x in got)


def test_substring_spans(spark):
    rows = [(1, "a b c d e f g h i j k l m n"), (2, "x a b c d e f g h i j k l m n y")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in substring_dedup(frame(spark, rows)).collect()}
    assert got == {1: [], 2: [(1, 15)]}
    assert substring_dedup(unlike(spark)).count() == 0


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def brute_lines(rows, min_chars=16):
    places = defaultdict(list)
    for i, t in rows:
        if i is not None and t is not None:
            for k, line in enumerate(t.split("\n")):
                if WORD.search(line):
                    places[line].append((i, k))
    first = {x: min(p) for x, p in places.items()}
    best = {}
    by_length = defaultdict(list)
    for x in first:
        by_length[len(x)].append(x)
    for x in first:
        near = [first[x]]
        if len(x) >= min_chars:
            near += [first[y] for n in (len(x) - 1, len(x), len(x) + 1) for y in by_length[n] if len(y) >= min_chars and within_one(x, y)]
        best[x] = min(near)
    gone = {p for x, ps in places.items() for p in ps if p > best[x]}
    return sorted(((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if i is None or (i, k) not in gone)) for i, t in rows), key=str)


@pytest.mark.parametrize("rows", ["odd", "long", "sf0.001"])
def test_line_dedup(spark, rows):
    if rows == "odd":
        rows = documents(5, 120)
    elif rows == "long":  # lines around the length of segments, edited in every place
        base = "".join(chr(97 + (i * 7 + i // 26) % 26) for i in range(200))
        texts = [base[:n] for n in (63, 64, 65, 127, 128, 129, 200)]
        rows = [(i, x) for i, x in enumerate(texts)]
        for t in texts[:5]:
            for at in (0, 1, 30, 31, 32, 61, 62, 63, 64, 65, len(t) - 1, len(t)):
                rows += [(len(rows), t[:at] + t[at + 1 :]), (len(rows) + 1000, t[:at] + "#" + t[at:]), (len(rows) + 2000, t[:at] + "é" + t[at + 1 :])]
    else:
        rows = sf_rows(spark)
    got = sorted(((r.doc_id, r.text) for r in line_dedup(frame(spark, rows)).collect()), key=str)
    assert got == brute_lines(rows)
    assert got != sorted(rows, key=str)
    assert line_dedup(unlike(spark)).count() == 0


def test_many_short_lines_one_edit_apart(spark):
    rows = [(i, f"a line that says {'abcdefghij'[i % 10]} {i // 10:03d} and no more") for i in range(10_000)]
    got = {r.doc_id: r.text for r in line_dedup(frame(spark, rows)).collect()}
    assert sorted(i for i, t in got.items() if t) == [i for i, t in brute_lines(rows[:400]) if t]  # all others are one edit from one of these


def test_near_equal_lines_of_a_million_characters(spark):
    import random

    r = random.Random(6)
    base = "".join(r.choice("abcdefgh ") for _ in range(1_000_000))
    rows = [(0, base), (1, base[:500_000] + "#" + base[500_001:]), (2, base[:70] + base[71:]), (3, base + "!"), (4, base[:999_990] + "##" + base[999_992:])]
    assert {x.doc_id: len(x.removed) for x in line_dedup(frame(spark, rows)).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0}


def brute_simhash(text, n=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64(" ".join(words[k : k + n]).encode(), 42).intdigest() for k in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("rows", ["odd", "sf0.001"])
def test_simhash(spark, rows):
    rows = documents(2) if rows == "odd" else sf_rows(spark)
    marks = [(i, brute_simhash(t)) for i, t in rows]
    fps = sorted({f for _, f in marks})
    parts = components(fps, [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2])
    least = {}
    for i, f in marks:
        if i is not None:
            least[parts[f]] = min(least.get(parts[f], i), i)
    want = sorted(((i, f"{f:016x}", least.get(parts[f])) for i, f in marks), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(frame(spark, rows)).collect()), key=str) == want
    assert simhash_components(unlike(spark)).count() == 0


def test_dense_cells_lose_nothing(spark):
    import random

    r = random.Random(4)
    centre = r.getrandbits(64)
    fps = {centre}
    while len(fps) < 300:
        x = r.choice(sorted(fps))
        for _ in range(r.randint(1, 2)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    pairs = near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), dense=8)
    got = {(r.a, r.b) for r in pairs.collect()}
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in got)
    want = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    assert components(signed, got) == components(signed, want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    want = components({x for e in edges for x in e if e[0] != e[1]}, edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(t, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def test_near_duplicates(spark):
    rows = sf_rows(spark) + [(i, t) for i, t in documents(3) if i is not None and i >= 900]
    rows = [(10_000 + k if i is None else i, t) for k, (i, t) in enumerate(rows)]
    edited = []
    for i, t in rows[:60]:
        w = (t or "").split()
        if len(w) > 120:
            w[50] = "edited"
            edited.append((20_000 + i, " ".join(w)))
    rows += edited
    text = {i: shingles(t) for i, t in rows}
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows)).collect()}
    ids = sorted(text)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(text[a], text[b]) >= 0.8]
    want = components(ids, links)
    assert all(want[a] == want[c] for a, c in got.items())  # no group holds what does not belong together
    assert sum(got[a] == got[b] for a, b in links) >= 0.95 * len(links) > 0
    assert near_duplicates(unlike(spark)).count() == 0


def test_rows_that_share_a_doc_id_are_kept_apart(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, one), (1, two), (2, one + " more"), (3, two), (None, one), (1, one), (4, None), (5, "")]
    got = drop_near_duplicates(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, one), (1, two), (None, one), (4, None)], key=str)
    assert drop_near_duplicates(unlike(spark)).count() == 0


def test_dropping_takes_the_links_of_simhash(spark):
    """Two texts of one repeated passage, the second with more behind, have the same fingerprint and a similarity of 0.6; the
    third is over 0.8 like the fourth, whose fingerprint is another."""
    passage = " ".join(f"p{i}" for i in range(31))
    rows = [(1, " ".join([passage] * 50)), (2, " ".join([passage] * 50 + [f"more{i}" for i in range(15)]))]
    words = [f"w{i}" for i in range(100)]
    rows += [(3, " ".join(words)), (4, " ".join(words[:50] + ["x"] + words[50:]))]
    assert brute_simhash(rows[0][1]) == brute_simhash(rows[1][1]) and jaccard(shingles(rows[0][1]), shingles(rows[1][1])) < 0.8
    assert bin(brute_simhash(rows[2][1]) ^ brute_simhash(rows[3][1])).count("1") > 2 and jaccard(shingles(rows[2][1]), shingles(rows[3][1])) >= 0.8
    assert sorted(r.doc_id for r in drop_near_duplicates(frame(spark, rows)).collect()) == [1, 3]


def test_line_dedup_of_very_many_lines(spark):
    """Four hundred thousand equal lines in one text take seconds, and so do as many different ones of which every other goes."""
    import time

    n = 400_000
    rows = [(1, "\n".join(f"line number {i} of the first one" for i in range(0, n, 2))), (2, "\n".join(f"line number {i} of the first one" for i in range(n))), (3, "the same line again\n" * n + "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n, r.text) for r in line_dedup(df, 1 << 20).selectExpr("doc_id", "size(removed) AS n", "text").collect()}
    assert time.time() - began < 120
    assert got[1][0] == 0 and got[2] == (n // 2, "\n".join(f"line number {i} of the first one" for i in range(1, n, 2)))
    assert got[3] == (n - 1, "the same line again\nend")
