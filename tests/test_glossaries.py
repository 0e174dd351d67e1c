"""Glossaries and names from tables against plain Python, over tables and random texts."""

import hashlib
import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quirefold.operators import chunks, scan
from quirefold.operators import glossaries as g
from quirefold.plans import catalog

D = "/root/testdata/sf0.001"
LETTERS = "abc -_."


def strings(r, n, most):
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(1, most))) for _ in range(n)]


def data(seed=1, novels=6, texts=40):
    r = random.Random(seed)
    terms = {f"n{k}": [(s, r.choice(["<", "b&c", "xyz", s + "a", " ", ""]), r.choice(["character_name", "term"])) for s in {*strings(r, r.randint(0, 12), 4), ""}] for k in range(novels)}
    rows = [(i, f"n{i % (novels + 1)}" if i % 11 else None, r.choice([None, "", "".join(r.choice(LETTERS + "中") for _ in range(r.randint(1, 60)))])) for i in range(texts * novels)]
    return terms, rows


def longest(usable, text, told):
    if not usable:
        return text
    usable = sorted(usable, key=lambda t: (-len(t[0]), t[0]))
    return re.sub("|".join(re.escape(s) for s, *_ in usable), lambda m: told(m[0], usable), text)


def frames(spark, terms, rows, parts=1 << 25):
    return spark.createDataFrame(rows, "id int, novel_id string, text string"), spark.createDataFrame([(n, *t) for n, ts in terms.items() for t in ts] + [(None, "a", "never", "term")], "novel_id string, source string, target string, kind string")


@pytest.mark.parametrize("part_bytes", [1 << 25, 100])
def test_terms_of_novels(spark, part_bytes):
    terms, rows = data()
    texts, table = frames(spark, terms, rows)
    usable = lambda n: [t for t in terms.get(n, []) if t[0].strip() and t[1].strip()]
    got = {r.id: r.primed for r in g.prime(texts, table, part_bytes=part_bytes).collect()}
    tagged = {r.id: r.protected for r in g.protect(texts.withColumn("protected", F.lit(1)), table, part_bytes=part_bytes).collect()}
    assert len(got) == len(tagged) == len(rows)
    for i, n, text in rows:
        if text is None:
            assert got[i] is None and tagged[i] is None
            continue
        assert got[i] == longest(usable(n), text, lambda s, ts: dict((x[0], x[1]) for x in ts)[s])
        assert tagged[i] == longest(usable(n), text, lambda s, ts: f'<locked-term data-id="t{[x[0] for x in ts].index(s)}">{html.escape(dict((x[0], x[1]) for x in ts)[s])}</locked-term>')
    said = texts.withColumn("translated", F.when(F.col("id") % 5 > 0, F.replace("text", F.lit("a"), F.lit("xyz"))))
    for r in g.check(said, table, part_bytes=part_bytes).collect():
        if r.text is None:
            assert r.violations is None
            continue
        out, own = r.translated or "", [t for t in usable(r.novel_id) if t[0] in r.text]
        missing, left = [t for t in own if t[1] not in out], [t for t in own if t[0] not in t[1] and t[0] in out]
        v = r.violations
        assert (v.empty, sorted(v.missing), sorted(v.untranslated), v.hard) == (not out.strip(), sorted(t[1] for t in missing), sorted(t[0] for t in left), any(t[2] == "character_name" for t in missing + left))


def test_names_of_novels(spark):
    r = random.Random(2)
    names = {f"n{k}": {f"k{j}": s for j, s in enumerate(dict.fromkeys(strings(r, r.randint(0, 9), 3)))} for k in range(5)}
    rows = [(i, f"n{i % 6}", "".join(r.choice(LETTERS) for _ in range(r.randint(0, 40)))) for i in range(400)]
    texts, table = spark.createDataFrame(rows, "id int, novel_id string, text string"), spark.createDataFrame([(n, k, s) for n, x in names.items() for k, s in x.items()], "novel_id string, key string, spelling string")
    marked, named = {x.id: x.marked for x in g.mark(texts, table).collect()}, {x.id: x.named for x in g.name(texts, table).collect()}
    for i, n, text in rows:
        spans, taken = [], set()
        for key, s in sorted(names.get(n, {}).items(), key=lambda x: (-len(x[1]), x[0])):
            for m in re.finditer(rf"(?<![\w-]){re.escape(s)}(?![\w-])", text):
                if not taken & set(range(*m.span())):
                    taken |= set(range(*m.span()))
                    spans.append((*m.span(), key))
        out, at = "", 0
        for a, b, key in sorted(spans):
            out, at = out + text[at:a] + f"⟦{key}⟧", b
        assert marked[i].text == out + text[at:], (text, names[n])
        assert marked[i].order == list(dict.fromkeys(k for _, _, k in sorted(spans)))
        assert sorted(named[i]) == sorted({k for _, _, k in spans})


@pytest.mark.parametrize("text, pairs, others, lang, want", [
    ("Long Fei met Fei.", [("Fei", "Faye")], ["Long Fei"], "en", "Long Fei met Faye."), ("Long Fei", [("Fei", "Faye")], ["Long Fei"], "en", None), ("Feier and Fei_", [("Fei", "Faye")], [], "en-GB", None),
    ("龙飞来了", [("龙飞", "Long")], [], "zh-Hans", "Long来了"), ("x", [("a", "a"), ("", "b")], [], "en", "x"), ("A and B", [("A", "B"), ("B", "A")], [], "en", "B and A"), ("a.b (c) a.b", [("a.b", "d"), ("(c)", "\\E$1")], [], "en", "d \\E$1 d"), ("Ann met Ann", [("Ann", "Bo"), ("Cy", "Di")], [], "en", None),
])
def test_respelled_names(spark, text, pairs, others, lang, want):
    texts = spark.createDataFrame([("n", text, lang), ("m", text, lang), (None, text, lang)], "novel_id string, text string, lang string")
    table = spark.createDataFrame([("n", a, b) for a, b in pairs] + [("n", o, None) for o in others], "novel_id string, source string, target string")
    got = {r.novel_id: r.respelled for r in g.respell(texts, table).collect()}
    assert got == {"n": want, "m": text, None: text}


def test_a_novel_is_split_over_tasks(spark):
    """Ten thousand terms, one novel with all texts, parts of a few kilobytes: every part gets the terms, none all texts."""
    terms = [("n", f"term{k:05d}", f"T{k}", "term") for k in range(10_000)]
    texts = spark.createDataFrame([("n", i, " ".join(f"term{(i * 37 + j) % 10_000:05d}" for j in range(50))) for i in range(300)], "novel_id string, id int, text string")
    table = spark.createDataFrame(terms, "novel_id string, source string, target string, kind string")
    got = g.prime(texts, table, part_bytes=20_000)
    assert all(r.primed == " ".join(f"T{(r.id * 37 + j) % 10_000}" for j in range(50)) for r in got.collect())
    big = g.large_keys(texts, ["novel_id"], F.octet_length("text"), 20_000, "parts").collect()
    assert [r.parts for r in big] == [-(-sum(len(r.text) for r in texts.collect()) // 20_000)]


def test_a_long_glossary_is_not_sent_for_every_few_texts(spark):
    """What is shuffled stays near the bytes of the texts and one glossary, however small the parts asked for are."""

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        jvm, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(12)) for _ in range(10_000)]
    rows = [("n", i, " ".join(r.choice(words) for _ in range(50))) for i in range(600)]
    texts = spark.createDataFrame(rows, "novel_id string, id int, text string")
    table = spark.createDataFrame([("n", w, w.upper()) for w in words], "novel_id string, source string, target string")
    before = shuffled()
    got = {x.id: x.primed for x in g.prime(texts, table, part_bytes=4000).collect()}
    assert got == {i: t.upper() for _, i, t in rows}
    assert shuffled() - before < 4 * sum(len(t) for *_, t in rows)


def test_linear_in_hits():
    terms = g.Terms([{"source": f"t{k}", "target": f"T{k}", "kind": "term"} for k in range(2000)])
    names = g.Names([{"key": str(k), "spelling": f"t{k}"} for k in range(2000)])
    took = []
    for n in (20_000, 80_000):
        text = " ".join(f"t{k % 2000}" for k in range(n))
        began = time.perf_counter()
        assert terms.primed({"text": text}) == text.replace("t", "T")
        assert len(names.marked({"text": text})["order"]) == 2000
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_novel_glossaries_query(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    words = {}
    for _, source, text in docs:
        words.setdefault(source, set()).update(re.findall(r"[^\W\d_]{6,}", text))
    got = {r.doc_id: r.primed for r in catalog.QUERIES["t07_novel_glossaries"](spark, D).collect()}
    upper = {}
    for r in spark.createDataFrame([(w,) for x in words.values() for w in x], "w string").select("w", F.upper("w").alias("u")).collect():
        upper[r.w] = r.u
    for doc_id, source, text in docs[:60]:
        pattern = "|".join(re.escape(w) for w in sorted(words[source], key=len, reverse=True))
        assert got[doc_id] == hashlib.sha256(re.sub(pattern, lambda m: f"«{upper[m[0]]}»", text).encode()).hexdigest()


def test_scan_is_leftmost_longest(spark):
    r = random.Random(9)
    for _ in range(8):
        surfaces = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 8))})
        texts = ["".join(r.choice("abc") for _ in range(r.randint(0, 30))) for _ in range(40)]
        df = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], "id int, text string, lang string")
        got = {x.id: [(s.alias_id, s.char_start, s.char_end) for s in x.spans] for x in scan.scan_mentions(df, spark.createDataFrame([(s, s) for s in surfaces], "alias_id string, surface string")).collect()}
        pattern = "|".join(sorted(surfaces, key=len, reverse=True))
        for i, t in enumerate(texts):
            assert got[i] == [(m[0], m.start(), m.end()) for m in re.finditer(pattern, t)]


def test_long_paragraphs_are_cut_in_linear_time():
    """Sentences stand where they first occur in their paragraph, also within others, however long it is."""
    r = random.Random(3)
    text = "".join(r.choice(["No. ", "He said No. ", "Yes! ", f"Number {r.randint(0, 400)}. "]) for _ in range(900))
    short, chunks._SHORT = chunks._SHORT, 1 << 30
    want = chunks.chunk(text, "en", 20)
    chunks._SHORT = 0
    assert chunks.chunk(text, "en", 20) == want
    chunks._SHORT = short
    long = "".join(f"This is sentence {k} of one long paragraph. " for k in range(30_000))
    began = time.perf_counter()
    assert len(chunks.chunk(long, "en", 400)) > 100 and time.perf_counter() - began < 5
