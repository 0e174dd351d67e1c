"""Functions on glossaries, answers and keys against plain Python, over whole tables and odd rows."""

import hashlib
import json
import re
import uuid

import pytest
from pyspark.sql import functions as F

from quirefold.functions import glossary, keys
from quirefold.functions.text import PROFILES
from quirefold.operators import chunks, hashing, pagemodels
from quirefold.plans import catalog
from quirefold.sources import objects

D = "/root/testdata/sf0.001"


def turns(spark):
    return [(r.conv_id, r.turn, r.text, r.role) for r in spark.read.parquet(f"{D}/conversations.parquet").collect()]


NAMES = {"1": "the", "2": "of the", "3": "a"}


def brute_spans(text):
    taken, out = set(), []
    for key in sorted(NAMES, key=lambda k: -len(NAMES[k])):
        for m in re.finditer(rf"(?<![\w-]){re.escape(NAMES[key])}(?![\w-])", text):
            if not taken & set(range(*m.span())):
                taken |= set(range(*m.span()))
                out.append((m.start(), m.end(), key))
    return sorted(out)


def test_marked(spark):
    got = {(r.conv_id, r.turn): (r.text, r.order) for r in catalog.QUERIES["t08_marked"](spark, D).collect()}
    for conv, turn, text, _ in turns(spark):
        spans, order, out, at = brute_spans(text), [], "", 0
        for a, b, key in spans:
            out, at = out + text[at:a] + f"⟦{key}⟧", b
            order += [] if key in order else [key]
        assert got[conv, turn] == (out + text[at:], ",".join(order))


def test_named_in(spark):
    got = {(r.conv_id, r.turn): r.named for r in catalog.QUERIES["t47_named_in"](spark, D).collect()}
    for conv, turn, text, _ in turns(spark):
        found = []
        for key in sorted(NAMES, key=lambda k: -len(NAMES[k])):
            pattern = rf"(?<![\w-]){re.escape(NAMES[key])}(?![\w-])"
            if re.search(pattern, text):
                found.append(key)
                text = re.sub(pattern, " ", text)
        assert got[conv, turn] == ",".join(found)


def test_replayed(spark):
    got = {(r.conv_id, r.turn): (r.text, r.n_spans) for r in catalog.QUERIES["e17_l04_replayed"](spark, D).collect()}
    spans = [(0, 2, "", True), (4, 4, "z", True), (5, 9, "NEW", True), (7, 12, "x", True), (12, 15, "y", False), (30, 31, "longer", True)]
    for conv, turn, text, _ in turns(spark):
        out, at, n = "", 0, 0
        for a, b, target, locked in spans:
            if a >= at and b > a and b <= len(text):
                out, at, n = out + text[at:a] + (target if locked and target else text[a:b]), b, n + 1
        assert got[conv, turn] == (out + text[at:], n)


def test_broken_tags(spark):
    assert spark.range(1).select(glossary.unprotected(F.lit('a <locked-term data-id="t1">b'))).first()[0] is None



def brute_chunks(text, lang, budget):
    """The rule in other words: sentences are added to a chunk until the next would overflow it."""
    ends, rate = PROFILES.get(lang, PROFILES["en"])
    out, cur, size, pos = [], None, 0.0, 0
    for paragraph in text.split("\n\n"):
        begin, pos = pos, pos + len(paragraph) + 2
        piece = ""
        for c in paragraph + "\0":
            if c != "\0":
                piece += c
            if (c in ends or c == "\0") and piece:
                if piece.strip():
                    at = text.index(piece, begin)
                    if cur is not None and size + len(piece) / rate > budget:
                        out.append(tuple(cur))
                        cur, size = None, 0.0
                    cur = [at if cur is None else cur[0], at + len(piece)]
                    size += len(piece) / rate
                piece = ""
    return out + ([tuple(cur)] if cur else [])


def test_chunks(spark):
    odd = [(-1, "Hi. Hi. Hi.\n\nOne two.\n\n\n\nThree! ", "en"), (-2, "", "en"), (-3, None, None), (-4, "。" * 9 + "一二三。\n\n四五", "zh"), (-5, "x" * 5000, "de"), (-6, "A.\n\nB.\n\nC.", "en")]
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    for budget in (20, 400):
        for r in chunks.chunk_text(docs, budget).collect():
            text = r.text or ""
            assert [(c.start, c.end) for c in r.chunks] == brute_chunks(text, r.lang, budget) and all(c.text == text[c.start : c.end] for c in r.chunks)
    assert {r.doc_id: len(r.chunks) for r in chunks.chunk_text(docs.where("doc_id = -6"), 400).collect()} == {-6: 1}
    parts = {}
    for r in chunks.translation_parts(docs, 50).orderBy("part").collect():
        parts.setdefault(r.doc_id, []).append(r.text)
    for r in docs.collect():
        most, want = int(50 * PROFILES.get(r.lang, PROFILES["en"])[1]), []
        for a, b in brute_chunks(r.text or "", r.lang, 50):
            want += [r.text[k : min(k + most, b)] for k in range(a, b, most)]
        assert parts.get(r.doc_id, []) == [x for x in want if x.strip()]


def test_simhash(spark):
    import unicodedata

    texts = ["", "ab", "Ab  C", "ﬁne words of a text", "x" * 3000, None] + [r.text for r in spark.read.parquet(f"{D}/documents.parquet").limit(40).collect()]
    got = {r.i: (r.simhash, r.sha256) for r in hashing.hash_content(spark.createDataFrame(list(enumerate(texts)), "i long, text string")).collect()}
    for i, t in enumerate(texts):
        plain = " ".join(unicodedata.normalize("NFKC", t or "").lower().split())
        marks = [int.from_bytes(hashlib.sha256(plain[k : k + 5].encode()).digest()[:8], "big") for k in range(max(1, len(plain) - 4))]
        value = sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in marks) > len(marks))
        assert got[i][0] == f"simhash64-v1:{value:016x}"


def test_keys(spark):
    got = {(r.conv_id, r.turn): (r.id, r.json) for r in catalog.QUERIES["t37_t38_stable_ids"](spark, D).collect()}
    for conv, turn, text, role in turns(spark):
        assert got[conv, turn] == (str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([role, text], ensure_ascii=False))), hashlib.sha256(json.dumps(text + 'é\U0001f600"\\\n\x01').encode()).hexdigest())
    spaces = spark.range(1).select(keys.embedding_space(F.lit("ollama"), F.lit("models/ünï"), F.lit(768), F.lit("http://h//")))
    assert spaces.first()[0] == hashlib.sha256(json.dumps(["ollama", "ünï", 768, "http://h"]).encode()).hexdigest()


def test_evidence(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = {r.doc_id: r.evidence for r in catalog.QUERIES["t31_evidence"](spark, D).collect()}
    for i, t in texts.items():
        if "1" in t:
            a = t.index("1")
            left, stop = max(t.rfind("。", 0, a), t.rfind("\n", 0, a)) + 1, t.find("。", a + 1)
            assert got[i] == t[left : stop + 1 if stop >= 0 else a + 181]


def test_mention_ranking(spark):
    people = list(NAMES.values())
    whole = lambda x: rf"(?<![\w-]){re.escape(x)}(?![\w-])"
    want = {}
    for name in people:
        longer = [x for x in people if x != name and re.search(whole(name), x)]
        n = 0
        for _, _, text, _ in turns(spark):
            for x in longer:
                text = re.sub(whole(x), " ", text)
            n += bool(re.search(whole(name), text))
        want[name] = n
    facts = spark.read.parquet(f"{D}/conversations.parquet").select(F.concat_ws(":", "conv_id", "turn").alias("fact_id"), "text")
    got = {r.name: r.n for r in pagemodels.mention_ranking(facts, spark.createDataFrame([(x,) for x in people], "name string")).collect()}
    assert got == want


def test_spans_at_edges(spark):
    """Emoji before a name, a surface of two aliases, and a longest match without boundary."""
    from quirefold.operators import scan

    aliases = spark.createDataFrame([("1", "Chen"), ("2", "Chen"), ("3", "Long Fei"), ("4", "Fei"), ("5", "")], "alias_id string, surface string")
    docs = spark.createDataFrame([(1, "😀 Chen é Long Feix Fei", "en-GB"), (2, "x龙Chen来", "zh-Hans"), (3, None, "en")], "id long, text string, lang string")
    got = {r.id: [tuple(s) for s in r.spans] for r in scan.scan_mentions(docs, aliases).collect()}
    assert got == {1: [("1", 5, 9, 2, 6), ("2", 5, 9, 2, 6), ("4", 23, 26, 19, 22)], 2: [("1", 4, 8, 2, 6), ("2", 4, 8, 2, 6)], 3: []}


def test_objects(spark, tmp_path):
    base = str(tmp_path / "bodies")
    rows = spark.createDataFrame([("n1", 1, "one\ntwo"), ("n1", 2, ""), ("n2", 1, "drei")], "novel_id string, chapter_index int, text string")
    objects.write_bodies(rows, base)
    objects.write_bodies(rows.where("chapter_index = 1 and novel_id = 'n1'").withColumn("text", F.lit("new")), base)
    assert sorted(tuple(r) for r in objects.read_bodies(spark, base).select("novel_id", "chapter_index", "text").collect()) == [("n1", 1, "new"), ("n1", 2, ""), ("n2", 1, "drei")]
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert sorted((r.a, r.b) for r in objects.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a long, b string").collect()) == [(1, "x"), (2, None)]
    (tmp_path / "t.txt").write_text("whole\ntext")
    assert objects.read_texts(spark, str(tmp_path / "t.txt")).first().text == "whole\ntext"


def test_walk(spark):
    rows = [("a", "one " * 9, "b", False), ("b", "two " * 9, "c", True), ("c", "three " * 9, "d", False), ("d", "s", "e", False), ("e", "s", "f", False), ("g", "gone", "h", False), ("z", "end", None, False)]
    pages = spark.createDataFrame(rows, "url string, text string, next_url string, continues boolean")
    got = objects.walk(pages, spark.createDataFrame([("w1", "a"), ("w2", "g"), ("w3", "z"), ("w4", "none")], "walk string, url string"), 20)
    chapters = sorted((r.walk, r.chapter, r.source_url, r.text) for r in got[0].collect())
    assert chapters == [("w1", 1, "a", "one " * 9), ("w1", 2, "b", "two " * 9 + "\n\n" + "three " * 9), ("w1", 3, "d", "s"), ("w2", 1, "g", "gone"), ("w3", 1, "z", "end")]
    assert sorted((r.walk, r.reason) for r in got[1].collect()) == [("w1", "duplicate_content"), ("w2", "not_found"), ("w3", "no_next_link"), ("w4", "not_found")]


def events(spark):
    return [r for r in spark.read.parquet(f"{D}/events.parquet").selectExpr("event_id", "user_id", "event_type", "cast(unix_timestamp(ts) as double) s", "cast(get_json_object(props, '$.k') as int) k").orderBy("s", "event_id").collect()]


def test_limit_and_permits(spark):
    got = {r.event_id: r.allowed for r in catalog.QUERIES["j11_limit"](spark, D).collect()}
    logs = {}
    for e in events(spark):
        accepted = logs.setdefault(e.user_id, [])
        first = accepted[-1][2] if accepted else None  # start of the window of the last accepted call
        fresh = first is None or e.s - first >= 86400
        n = 0 if fresh else sum(x[2] == first for x in accepted)
        busy = any(x[0] <= e.s < x[1] for x in accepted)
        ok = n < 3 and not busy
        if ok:
            end = min(e.s + 86400, e.s + e.k * 3600 if e.event_id % 5 else float("inf"))
            accepted.append((e.s, end, e.s if fresh else first))
        assert got[e.event_id] == ok
    got = {r.event_id: r.outcome for r in catalog.QUERIES["j12_permits"](spark, D).collect()}
    held = {}
    for e in events(spark):
        own = held[e.event_type] = {k: t for k, t in held.get(e.event_type, {}).items() if e.s - t < 7200}
        if e.user_id % 3 == 0:
            want = "settled" if own.pop(e.user_id - 1, None) is not None else "late"
        else:
            want = "refused" if e.user_id in own or len(own) >= 3 else "granted"
            if want == "granted":
                own[e.user_id] = e.s
        assert got[e.event_id] == want
    assert {"granted", "refused", "late"} <= set(got.values())


@pytest.mark.parametrize("dense", [64, 2])
def test_near_marks(spark, dense):
    """Every pair of marks within three bits, dense band values included."""
    import random

    r = random.Random(3)
    marks = {r.getrandbits(64) for _ in range(150)}
    for m in list(marks)[:60]:
        for _ in range(4):
            x = m
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
            marks.add(x)
    shared = [(0xABCD << 48) | r.getrandbits(48) for _ in range(80)]
    marks = sorted(marks | set(shared) | {s ^ 1 << 63 ^ 1 << 3 for s in shared})
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    got = {(x.a, x.b): x.distance for x in hashing.near_by_bands(spark.createDataFrame(list(enumerate(signed)), "id long, mark long"), dense).collect()}
    want = {(i, j): d for i in range(len(marks)) for j in range(i + 1, len(marks)) if (d := (marks[i] ^ marks[j]).bit_count()) <= 3}
    assert got == want and len(want) > 200
