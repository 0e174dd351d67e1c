"""The pipeline's near-duplicates find every link: edited copies of one master, and planted edits by band of similarity."""

import os
import random
from collections import Counter

from quirefold.llm.common import saved, scratch, shared_dir
from quirefold.llm.shingle_join import _candidates, similar_links
from quirefold.llm.simhash_dedup import drop_near_duplicates, near_duplicates
from tests.llm.fixtures import frame
from tests.llm.test_text_dedup import components, jaccard, shingles


def test_copies_of_a_master_with_a_large_id(spark):
    r = random.Random(8)
    master = [f"m{i}" for i in range(200)]
    rows = [(90_000, " ".join(master))]
    for i in range(2500):  # each is over 0.8 like the master, and most are under 0.8 like each other
        words = list(master)
        for at in r.sample(range(10, 190, 12), 4):
            words[at] = f"e{r.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    assert all(jaccard(sets[0], x) >= 0.8 for x in sets[1:])
    assert sum(jaccard(sets[k], sets[k + 1]) < 0.8 for k in range(1, 1000)) > 900
    got = {x.doc_id: x.component_id for x in near_duplicates(frame(spark, rows)).collect()}
    assert set(got.values()) == {0} and len(got) == len(rows)
    small = spark.createDataFrame(rows[:400], "doc_id long, text string")
    links = [(x.a, x.b) for x in similar_links(small, 5, 0.8, chunk=20_000).collect()]  # over many tiles
    assert set(components([i for i, _ in rows[:400]], links).values()) == {0}
    assert len(links) < 400 * 80  # forests, not pairs


def test_recall_by_band(spark):
    r, rows = random.Random(9), []
    fresh = iter(range(10**9))
    for base in range(0, 9000, 10):
        n = r.choice([6, 40, 150, 300])
        words = [f"w{next(fresh)}" for _ in range(n)]
        new = [f"w{next(fresh)}" for _ in range(max(1, r.randint(n // 40, n // 4)))]
        if base % 20:  # a passage, in front, behind or within
            at = r.choice([0, n, n // 2])
            copy = words[:at] + new + words[at:]
        else:
            copy = list(words)
            for x in r.sample(range(n), max(1, round(n * r.choice([0.003, 0.01, 0.02, 0.03, 0.04])))):
                copy[x] = f"w{next(fresh)}"
        rows += [(base, " ".join(words)), (base + 1, " ".join(copy))]
    text = dict(rows)
    got = {x.doc_id: x.component_id for x in near_duplicates(frame(spark, rows)).collect()}
    links, found = Counter(), Counter()
    for base in range(0, 9000, 10):
        like = jaccard(shingles(text[base]), shingles(text[base + 1]))
        band = min(int(like * 20), 19) if like >= 0.8 else 0
        links[band, base % 20] += 1
        found[band, base % 20] += got[base] == got[base + 1]
    for band in (16, 17, 18, 19):
        for kind in (0, 10):
            assert links[band, kind] >= 10 and found[band, kind] == links[band, kind], (band, kind, links, found)
    assert not found[0, 0] and not found[0, 10]


def test_shared_passages_do_not_chain_documents(spark):
    """Twenty thousand documents of four passages, each passage in three documents on average: what is compared grows with
    the documents, and the few near-copies among them are found."""
    r, n = random.Random(5), 20_000
    passages = [" ".join(f"p{k}w{j}" for j in range(40)) for k in range(4 * n // 3)]
    rows = [(i, " ".join(r.sample(passages, 4))) for i in range(n)]
    copies = [(n + k, rows[k * 97][1] + " and more") for k in range(50)]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string").repartition(8)
    groups, alone = _candidates(docs, 5, 0.8)
    sizes = [x["count"] for x in groups.groupBy("component").count().collect()]
    assert max(sizes, default=0) <= 64 and sum(x * x for x in sizes) + alone.count() < 20 * n
    assert groups.count() + alone.count() > n  # most of them do meet
    links = {tuple(sorted((x.a, x.b))) for x in similar_links(docs, 5, 0.8).collect()}
    assert {(k * 97, n + k) for k in range(50)} <= links and len(links) < 60


def test_a_group_of_many_over_a_frequent_shingle(spark):
    """Near-copies in hundreds meet over shingles of many documents, those in tens over pairs; both are whole groups."""
    r, rows = random.Random(6), []
    for g, size in enumerate((2, 5, 31, 33, 70, 300)):
        words = [f"g{g}w{i}" for i in range(150)]
        for k in range(size):
            own = list(words)
            own[r.randrange(150)] = f"e{g}x{k}"
            rows.append((1000 * g + k, " ".join(own)))
    got = {x.doc_id: x.component_id for x in near_duplicates(frame(spark, rows)).collect()}
    assert all(c == i // 1000 * 1000 for i, c in got.items())


def test_scratch_tables_go(spark):
    rows = [(i, " ".join(f"w{j % (i + 3)}" for j in range(60))) for i in range(20)]
    place = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(place))
    kept = drop_near_duplicates(frame(spark, rows)).count()
    left = {x.split("-")[1] for x in set(os.listdir(place)) - before}
    assert kept > 0 and left == {"stay"}
    with scratch(spark, "b"):
        a, b = saved(spark.range(3), "a"), saved(spark.range(4), "b")
        assert a.count() == 3
    assert b.count() == 4 and not any("quirefold-a-" in x for x in set(os.listdir(place)) - before)
