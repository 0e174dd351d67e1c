"""Operator 11 against exact brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quirefold.llm import divergence as d

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, limit, top=50):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((x or "" for x in r) for r in rows):
        terms = TERM.findall(text.translate(LOWER))
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= limit)

        def shares(of, kept=kept):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)}
    return out


def rows(seed=3):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("Al", "bÉ", "ça", "dO", "eß", "😀", "z") for b in "abcdefgh"] + ["THE", "the", "The"]
    out = []
    for k in range(260):
        lang, source = r.choice(["en", "en", "de", None]), r.choice(["s1", "s2", "s2", "ö", None, ""])
        text = r.choice([" ", ", ", "1", "_"]).join(r.choices(words, [1 / (1 + (i * 7 + len(source or "")) % 13) for i in range(len(words))], k=r.randint(0, 40)))
        out.append((text if r.random() > 0.05 else None, lang, source))
    out += [("", "xx", "only"), (None, "xx", "none"), ("rare words here", "yy", "a"), out[0], out[0], ("the " * 20000, "en", "s1")]
    return out


@pytest.mark.parametrize("limit", [1, 12, 30])
def test_equals_brute_force(spark, limit):
    data = rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "text string, lang string, source string, term string, n int").repartition(5)
    got = [tuple(r) for r in d.divergence(df, limit).collect()]
    want = brute(data, limit)
    assert len(got) == len(want) and set(got) == want and any(x[2] == "term" for x in want)


def test_no_documents(spark):
    assert d.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_a_narrow_sketch_only_lets_more_through(spark):
    """With few cells nearly everything passes; with enough, terms under the limit are ruled out and none above it."""
    r = random.Random(1)
    data = [(" ".join(r.choice("abcdefghij") * 3 + str(k)[:0] + "".join(r.choices("klmnop", k=5)) for _ in range(60)), "en", "s") for k in range(400)]
    df = spark.createDataFrame(data, "text string, lang string, source string")
    true = Counter(t for text, _, _ in data for t in set(text.split()))
    seen = {}
    for bits in (15, 18):
        full = d.sketch(df, 3, bits)
        counted = df.mapInArrow(d.partial(d._counted, full=full, bits=bits), "lang string, source string, term string, n long, docs long").groupBy("term").sum("docs").collect()
        seen[bits] = {x[0]: x[1] for x in counted}
        assert all(seen[bits].get(t) == n for t, n in true.items() if n >= 3)
    rare = sum(n < 3 for n in true.values())
    assert sum(true[t] < 3 for t in seen[18]) <= sum(true[t] < 3 for t in seen[15]) and sum(true[t] < 3 for t in seen[18]) < 0.02 * rare
    assert np.unpackbits(d.sketch(df, 1, 15)).any()
