"""What tasks hold of large glossaries and of many rows."""

import random

import pyarrow as pa

from quirefold.operators import glossaries
from quirefold.operators.slices import slices


def test_strings_that_may_occur():
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdé字 ") for _ in range(n))
    texts = [text(r.randrange(60)) for _ in range(300)] + [None, ""]
    there = [t[a : a + r.randrange(1, 20)] for t in texts if t for a in (0, len(t) // 2, len(t) - 1)]
    strings = there + ["zz" + text(10) for _ in range(1000)] + ["", None, "q"]
    got = glossaries.occurring(pa.chunked_array([texts[:100], texts[100:]]), pa.chunked_array([strings[:50], strings[50:]]))
    assert got[: len(there)].all() and got[len(there) :].mean() < 0.05 and not got[-3:].any()
    none = pa.chunked_array([[]], pa.string())
    assert not glossaries.occurring(none, pa.chunked_array([["a", "longer than eight"]])).any() and len(glossaries.occurring(none, none)) == 0


def test_parts_of_a_glossary_do_what_all_of_it_does(monkeypatch):
    """With an automaton of the terms that occur, and with one of all."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 9)))
    rows = [{"source": word(), "target": r.choice([None, " ", word(), word()]), "kind": "term", "key": word(), "spelling": word()} for _ in range(3000)] + [{"source": None, "target": "x", "kind": None, "key": "k", "spelling": None}]
    terms = pa.Table.from_pylist(rows)
    texts = pa.Table.from_pylist([{"text": " ".join(word() for _ in range(r.randrange(30))), "translated": " ".join(word() for _ in range(20)), "lang": "en"} for _ in range(200)] + [{"text": None, "translated": None, "lang": None}])
    for kind, does in ((glossaries.Terms, "primed"), (glossaries.Terms, "protected"), (glossaries.Terms, "converted"), (glossaries.Terms, "checked"), (glossaries.Spellings, "respelled"), (glossaries.Names, "marked"), (glossaries.Names, "named")):
        both = []
        for some in (10, 1 << 30):
            monkeypatch.setattr(glossaries, "SOME", some)
            work = getattr(glossaries._known(texts, terms, kind, does), does)
            both.append([None if row["text"] is None else work(row) for row in texts.to_pylist()])
        assert both[0] == both[1]
    monkeypatch.setattr(glossaries, "SOME", 1)
    few = pa.Table.from_pylist([{"source": "one", "target": "1"}, {"source": "two", "target": "2"}, {"source": "three", "target": None}])
    for text, want in (("one two", "1 2"), ("one", None)):
        own = pa.Table.from_pylist([{"text": text, "lang": "en"}])
        assert glossaries._known(own, few, glossaries.Spellings, "respelled").respelled({"text": text, "lang": "en"}) == want


def test_a_text_of_a_large_glossary_is_checked_by_what_it_holds():
    """Two hundred thousand terms and twenty thousand texts took a look at each term for each text."""
    import time

    known = glossaries.Terms([{"source": f"word{i}x", "target": f"W{i}", "kind": "term"} for i in range(200_000)])
    began = time.time()
    for i in range(20_000):
        assert known.checked({"text": f"word{i}x and word{i + 1}x", "translated": f"W{i}"})["missing"] in ([f"W{i + 1}"], [])
    assert time.time() - began < 30


def test_rows_are_cut_by_bytes():
    texts = ["x" * n for n in (10, 2000, 5, 0, 900, 30)] + [None] * 40
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "text": texts})
    parts = list(slices([batch, batch.slice(0, 0)], "text", 1000))
    assert [i for p in parts for i in p["i"].to_pylist()] == list(range(len(texts))) and len(parts) > 3
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p["text"].to_pylist()) <= 1000 for p in parts)
