"""Script conversion, spellings by readings, and fan-out of confirmed spellings."""

import itertools
import random

import pytest

from quirefold.operators import fanout, glossaries, scripts

#: A small table of phrases: single characters, and phrases that take another character than theirs alone.
S2T = {"莲": "蓮", "职": "職", "头": "頭", "发": "發", "头发": "頭髮", "裁决": "裁決", "会": "會", "后": "後", "皇后": "皇后", "里": "裡", "里程": "里程"}
T2S = {"蓮": "莲", "職": "职", "頭": "头", "髮": "发", "發": "发", "決": "决", "會": "会", "後": "后"}


def phrases(spark):
    return spark.createDataFrame([("s2t", a, b) for a, b in S2T.items()] + [("t2s", a, b) for a, b in T2S.items()], "kind string, source string, target string")


def test_conversion_takes_the_longest_phrase(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("莲职头发皇后里程裁决会x 。") for _ in range(r.randint(0, 30))) for _ in range(80)] + [None]
    df = spark.createDataFrame([(i, t, "s2t") for i, t in enumerate(texts)], "id int, text string, kind string")
    got = {x.id: x.converted for x in glossaries.convert(df, phrases(spark)).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
            continue
        out, at, spans = "", 0, []
        while at < len(t):
            hit = max((s for s in S2T if t.startswith(s, at)), key=len, default=None)
            if hit:
                spans.append((at, at + len(hit), len(out), len(out) + len(S2T[hit])))
            out += S2T[hit] if hit else t[at]
            at += len(hit) if hit else 1
        assert got[i].text == out and [tuple(s) for s in got[i].spans] == spans
        assert all(t[b:e] in S2T and out[s:p] == S2T[t[b:e]] for b, e, s, p in spans)


@pytest.mark.parametrize("term, text, want", [
    ("星蓮", "他在神職司院見到了星蓮。", "星蓮"), ("星莲", "他在神職司院見到了星蓮。", "星蓮"), ("神职司院", "他在神職司院見到了星蓮。", "神職司院"), ("星蓮", "他见到了星莲。", "星莲"), ("燕", "琰走了。", None), ("不存在", "他在神職司院。", None), ("", "琰", None), (None, "琰", None), ("星莲", None, None),
])
def test_source_forms(spark, term, text, want):
    df = spark.createDataFrame([(term, text, "old")], "term string, text string, form string")
    assert [r.form for r in scripts.source_forms(df, phrases(spark)).collect()] == [want]


READINGS = {"龍": ["long"], "飛": ["fei"], "安": ["an"], "若": ["ruo", "re"], "素": ["su"], "曾": ["ceng", "zeng"], "呂": ["lü"], "水": ["shui"], "寒": ["han"], "月": ["yue"]}


@pytest.mark.parametrize("surface, display, want", [
    ("龍飛", "Long Fei", ("Long Fei", "surname+given", 2, 0)), ("龍飛", "Dragon Fei", ("Long Fei", "surname+given", 1, 1)), ("水寒", "Water Cold", ("Shuihan", "mononym", 0, 2)), ("安若素", "An Ruosu", ("An Ruosu", "surname+given", 2, 0)), ("安若素", "An Re Su", ("An Re Su", "split", 3, 0)),
    ("曾月", "Zeng Yue", ("Zeng Yue", "surname+given", 2, 0)), ("曾月", "x", ("Cengyue", "mononym", 0, 2)), ("呂月", "Lv Yue", ("Lü Yue", "surname+given", 2, 0)), ("龍飛", "longfei", ("Longfei", "mononym", 1, 0)), ("龍飛", "Lord Long Fei", ("Long Fei", "surname+given", 2, 0)), ("龍飛", "Long Fei's Sword", ("Longfei", "mononym", 0, 2)),
    ("龍飛", " ", None), ("龍飛", None, None), ("龍王", "Long Wang", None), ("Long", "Long", None), ("龍飛龍飛龍飛龍", "x", None), (None, "x", None),
])
def test_spellings(spark, surface, display, want):
    table = spark.createDataFrame([(c, x, k) for c, o in READINGS.items() for k, x in enumerate(o)], "character string, reading string, rank int")
    got = scripts.spellings(spark.createDataFrame([(surface, display, 1)], "surface string, display string, plan int"), table).collect()
    assert [r.plan and (r.plan.target, r.plan.segmentation, r.plan.matched, r.plan.unmatched) for r in got] == [want]


def test_alignment_equals_all_cuts():
    """Against trying all ways to spell tails of words by tails of syllables."""
    r = random.Random(2)
    for _ in range(400):
        syllables = tuple(r.choice(["an", "a", "na", "lü", "lu", "n"]) for _ in range(r.randint(1, 6)))
        words = ["".join(r.choice(["an", "a", "na", "lu", "n"]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 4))]
        best = len(syllables)
        for k in range(len(words) + 1):
            for cuts in itertools.combinations_with_replacement(range(len(syllables) + 1), k):
                ends = [*cuts[1:], len(syllables)][:k]
                if all(a < b and scripts._plain("".join(syllables[a:b])) == w for a, b, w in zip(cuts, ends, words[len(words) - k :], strict=True)):
                    best = min([best, *cuts[:1]])
        unmatched, starts = scripts.aligned(syllables, words)
        assert unmatched == best and (starts or [len(syllables)])[0] == best


def test_fan_out(spark):
    glossary = spark.createDataFrame([("n", "a", "A", 2, False), ("n", "b", "B", 1, True)], "novel_id string, source_term string, target_term string, version int, deleted boolean")
    wanted = spark.createDataFrame([("n", "a", " A ", 1), ("n", "a", "A2", 1), ("n", "b", "B", 1), ("n", "c", "x" * 161, 1), ("n", "c", " ", 1), ("n", "d", "D", -1), ("m", "a", "A", 0)], "novel_id string, source_term string, target_term string, at_chapter int")
    changed = fanout.confirmed(wanted, glossary)
    assert sorted((r.novel_id, r.source_term, r.target_term, r.version) for r in changed.collect()) == [("m", "a", "A", 1), ("n", "a", "A2", 3), ("n", "b", "B", 2)]
    primed = spark.createDataFrame([("n", "a", "A"), ("n", "b", "B")], "novel_id string, source_term string, spelling string")
    held = spark.createDataFrame([("n", k, t) for k in range(3) for t in "abc"] + [("m", 1, "a"), ("n", 9, "a")], "novel_id string, chapter_index int, source_term string")
    chapters = spark.createDataFrame([("n", 0, True), ("n", 1, False), ("n", 2, True), ("m", 1, True)], "novel_id string, chapter_index int, translated boolean")
    got = sorted((r.novel_id, r.chapter_index, r.source_term, r.action) for r in fanout.messages(changed, primed, held, chapters).collect())
    assert got == [("m", 1, "a", "retranslate"), ("n", 0, "a", "respell"), ("n", 1, "a", "queue"), ("n", 1, "b", "queue"), ("n", 2, "a", "respell")]


def test_alignment_payloads(spark):
    """Every name once and in order, payloads as full as the budget allows, each name's paragraphs shown."""
    import json

    from quirefold.operators import alignment

    r = random.Random(7)
    names = [f"Name{k}" for k in range(30)]
    display = "\n".join(" ".join([r.choice(names) if r.random() < 0.4 else "word" for _ in range(20)]) + ("\n" if k % 7 == 0 else "") for k in range(60))
    source = "\n \n".join(f"源文第{k}段" * 4 for k in range(80))
    rows = [(1, source, display, [*names, "Nobody"]), (2, source, "", ["x"]), (3, None, None, ["x", ""]), (4, "a", "b", []), (5, "a", "b", None)]
    df = spark.createDataFrame(rows, "id int, source string, display string, names array<string>")
    got = {x.id: [p.asDict() for p in x.payloads] for x in alignment.alignment_payloads(df, 400).collect()}
    assert [n for p in got[1] for n in p["display_names"]] == [*names, "Nobody"] and len(got[1]) > 3
    left, right = [p for p in source.split("\n") if p.strip()], [p for p in display.split("\n") if p.strip()]
    cost = lambda p: alignment.tokens(json.dumps(p, ensure_ascii=False))
    for k, p in enumerate(got[1]):
        assert cost(p) <= 400 or len(p["display_names"]) == 1
        for n in p["display_names"]:
            at = next((i for i, x in enumerate(right) if n in x), 0)
            centre = round(at * len(left) / len(right))
            assert right[at] in p["translation"].split("\n") and set(left[max(centre - 4, 0) : centre + 5]) <= set(p["source"].split("\n"))
        assert p["source"].split("\n") == sorted(p["source"].split("\n"), key=left.index) and len(set(p["source"].split("\n"))) == len(p["source"].split("\n"))
        if k + 1 < len(got[1]):  # one more name would have been too much
            both = alignment.payloads(source, display, [*p["display_names"], got[1][k + 1]["display_names"][0]], 10**9)[0]
            assert cost(both) > 400
    assert got[2] == [{"source": "\n".join(left[:5]), "translation": "", "display_names": ["x"]}] and got[3] == [{"source": "", "translation": "", "display_names": ["x"]}] and got[4] == got[5] == []
