"""Documents whose sets of word shingles reach a Jaccard similarity, by an exact prefix filter.

All shingles stand in one order: those of a fixed half first, rare ones before common ones. Two sets of similarity t share a
shingle among the first n - ceil(t n) + 1 of each, n being the set's size, so documents that share none are not compared.
The order needs the counts of that half only; a document with too few shingles in it also gives its others.

A prefix shingle of few documents gives its pairs of like sizes. What such pairs connect is compared as a whole where it is
small; where it is large, only those pairs are, so passages that many unlike documents share in turn do not add up to a
comparison of them all. A prefix shingle of many documents joins them to a group by a star. Prefixes hold a document's rarest
shingles, so such documents hold hardly any that are rare.

Inside a group all sets are compared. A group is cut into bands by set size, of which only neighbours can be similar, and bands
into chunks by a hash. Each pair of chunks is one tile of bounded size, whatever the group's size, and gives a spanning forest
of its links instead of all of them, so the links' components are exact. Shingles are compared by 64 bits of hash, not by text.
"""

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import hashing
from quirefold.llm.common import on_group, partitions, saved, scratch
from quirefold.llm.components import connected_components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A chunk holds about so many shingles, and a document counts as DOC_COST more, since a tile's counts grow with its documents.
CHUNK, DOC_COST = 400_000, 150
#: Shingles of more documents of a tile than this are counted by products of matrices, others pair by pair.
RARE = 24
#: Documents of a prefix shingle up to which it gives pairs, and of what pairs connect up to which it is compared as a whole.
FEW, SMALL = 32, 64


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a text of fewer words has one shingle of all its words."""
    words, owners = hashing.hashed([x.translate(_LOWER) for x in texts])
    bounds = np.searchsorted(owners, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = words[a:b]
        out.append(np.unique(hashing.windows(own, min(shingle, b - a)).view(np.int64)) if b > a else np.zeros(0, dtype=np.int64))
    return out


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x.as_py() or b"" for x in batch["text"].cast(pa.binary())]


def _spare(n: int, similarity: float) -> int:
    """How many shingles of a set of n can be missing from a set that is similar to it."""
    return n - math.ceil(similarity * n - 1e-9)


def _indexed(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(_texts(batch), shingle)
        n, halves = [len(x) for x in sets], [x[x & 1 == 0] for x in sets]
        m = [len(x) for x in halves]
        given = [x if len(h) <= _spare(len(x), similarity) else h for x, h in zip(sets, halves, strict=True)]
        columns = [batch["doc_id"], pa.array(n, pa.int32()), pa.array(m, pa.int32()), pa.array([_spare(x, similarity) for x in n], pa.int32()), pa.array(given, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "m", "spare", "tokens"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(shingle_sets(_texts(batch), shingle), pa.list_(pa.int64()))], ["doc_id", "tokens"])


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of left shares with each of right."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    tokens = [np.concatenate(x) for x in (left, right)]
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    shared = np.intersect1d(*(np.unique(x) for x in tokens))
    if not len(shared):
        return out
    sides = []
    for t, o in zip(tokens, owners, strict=True):
        at = np.minimum(np.searchsorted(shared, t), len(shared) - 1)
        hit = shared[at] == t
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], o[hit][order]))
    (ta, oa), (tb, ob) = sides
    na, nb = np.bincount(ta, minlength=len(shared)), np.bincount(tb, minlength=len(shared))
    starts = np.concatenate(([0], np.cumsum(nb)[:-1]))
    few = nb <= RARE
    flat, use = out.reshape(-1), np.flatnonzero(few[ta])
    for lo in range(0, len(use), 1 << 17):
        t, o = ta[use[lo : lo + (1 << 17)]], oa[use[lo : lo + (1 << 17)]]
        total = int(nb[t].sum())
        within = np.arange(total) - np.repeat(np.cumsum(nb[t]) - nb[t], nb[t])
        cells, counts = np.unique(np.repeat(o, nb[t]) * len(right) + ob[np.repeat(starts[t], nb[t]) + within], return_counts=True)
        flat[cells] += counts
    many = np.flatnonzero(~few)
    column = np.full(len(shared), -1)
    column[many] = np.arange(len(many))
    pa_, pb_ = ~few[ta], ~few[tb]
    ca, ra, cb, rb = column[ta[pa_]], oa[pa_], column[tb[pb_]], ob[pb_]
    for lo in range(0, len(many), 1024):
        x, y = np.zeros((len(left), 1024), dtype=np.float32), np.zeros((len(right), 1024), dtype=np.float32)
        for c, r, to in ((ca, ra, x), (cb, rb, y)):
            a, b = np.searchsorted(c, [lo, lo + 1024])
            to[r[a:b], c[a:b] - lo] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def forest(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> list[tuple[int, int]]:
    """Edges (place in left, place in right) that span what the similar pairs connect; right is None for left with itself."""
    same = right is None
    right = left if same else right
    both = _common(left, right)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - both
    close = (both > 0) & (both / np.maximum(union, 1) >= similarity)
    seen = [np.zeros(len(left), dtype=bool)] * 2 if same else [np.zeros(len(left), dtype=bool), np.zeros(len(right), dtype=bool)]
    out = []
    for root in np.flatnonzero(close.any(axis=1)).tolist():
        if seen[0][root]:
            continue
        seen[0][root], stack = True, [(0, root)]
        while stack:
            side, x = stack.pop()
            other = 1 - side
            new = np.flatnonzero((close[:, x] if side else close[x]) & ~seen[other])
            seen[other][new] = True
            out += [(y, x) if side else (x, y) for y in new.tolist()]
            stack += [(other, y) for y in new.tolist()]
    return out


def _tile(rows: pa.Table, similarity: float) -> pa.Table:
    ids, tokens, side = rows["doc_id"].to_numpy(), rows["tokens"].combine_chunks(), rows["side"].to_numpy()
    ends, values = tokens.offsets.to_numpy(), tokens.values.to_numpy()
    sets = [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    left, right = np.flatnonzero(side < 2), np.flatnonzero(side == 2)
    alone = bool(len(side)) and not side.any()  # a chunk with itself
    if not len(left) or not (alone or len(right)):
        found = []
    else:
        found = forest([sets[i] for i in left], None if alone else [sets[i] for i in right], similarity)
    to = left if alone else right
    return pa.table({"a": pa.array([int(ids[left[x]]) for x, _ in found], pa.int64()), "b": pa.array([int(ids[to[y]]) for _, y in found], pa.int64())})


def _candidates(single: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Groups to compare as a whole (node, component, n: the set's size), and pairs (a, b) to compare by themselves."""
    spark = single.sparkSession
    with scratch(spark, "sizes", "firsts"):
        sizes, firsts = _prefixes(single, shingle, similarity)
    with scratch(spark, "groups", "alone"):
        return _met(sizes, firsts, similarity)


def _prefixes(single: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """doc_id and n, the size of each set, and doc_id, n and token of the prefixes."""
    kind, spark = "doc_id long, n int, m int, spare int, tokens array<long>", single.sparkSession
    late = F.col("token").bitwiseAND(F.lit(1)) == 1
    with scratch(spark, "index", "sizes", "repeated"):
        index = saved(single.mapInArrow(partial(_indexed, shingle=shingle, similarity=similarity), kind), "index")
        sizes = saved(index.select("doc_id", "n"), "sizes")
        each = index.select("doc_id", F.explode("tokens").alias("token"))
        repeated = saved(each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "repeated")
    with scratch(spark, "held"):
        held = each.join(repeated, "token").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(late.alias("late"), "df", "token"))).alias("held"))
        held = saved(held, "held")
    rows = held.join(index.select("doc_id", "n", "m", "spare"), "doc_id")
    early, rest = F.filter("held", lambda x: ~x["late"]), F.filter("held", lambda x: x["late"])
    rows = rows.withColumn("early", early).withColumn("rest", rest)
    # shingles of one document only come first in the order and use up places of the prefix
    take = F.greatest(F.lit(0), F.col("spare") + 1 - (F.col("m") - F.size("early")))
    more = F.greatest(F.lit(0), F.col("spare") + 1 - F.col("m") - (F.col("n") - F.col("m") - F.size("rest")))
    more = F.when(F.col("m") <= F.col("spare"), more).otherwise(0)
    prefix = F.concat(F.slice("early", F.lit(1), take), F.slice("rest", F.lit(1), more))
    firsts = saved(rows.select("doc_id", "n", F.explode(prefix).alias("x")).select("doc_id", "n", F.col("x.token").alias("token")), "firsts")
    return sizes, firsts


def _met(sizes: DataFrame, firsts: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The groups and pairs that share a shingle of their prefixes."""
    met = firsts.groupBy("token").agg(F.min("doc_id").alias("centre"), F.count("*").alias("df")).where("df > 1")
    met = saved(firsts.join(saved(met, "met"), "token"), "met")
    stars = met.where(F.col("df") > FEW).select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))
    dense = connected_components(stars)
    # shingles of one passage mostly have the same documents: each list once
    lists = met.where(F.col("df") <= FEW).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("doc_id", "n"))).alias("docs")).select("docs").distinct()
    pairs = lists.select("docs", F.posexplode("docs").alias("at", "a")).select("a", F.explode(F.slice("docs", F.col("at") + 2, FEW)).alias("b"))
    like = F.least("a.n", "b.n") >= F.ceil(similarity * F.greatest("a.n", "b.n") - 1e-9)
    pairs = saved(pairs.where(like).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct(), "pairs")
    loose = saved(connected_components(pairs), "loose")
    counts = saved(loose.groupBy("component").agg(F.count("*").alias("docs")), "counts")
    small = loose.join(counts.where(F.col("docs") <= SMALL).select("component"), "component")
    wide = loose.join(counts.where(F.col("docs") > SMALL).select("component"), "component").select(F.col("node").alias("a"))
    groups = dense.unionByName(small.select("node", (-1 - F.col("component")).alias("component")))  # numbers of their own
    return saved(groups.join(sizes.select(F.col("doc_id").alias("node"), "n"), "node"), "groups"), saved(pairs.join(wide, "a"), "alone")


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("ta", "tb")))
    return both.where(F.col("both") / (F.size("ta") + F.size("tb") - F.col("both")) >= similarity).select("a", "b")


def similar_links(single: DataFrame, shingle: int, similarity: float, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between rows of single (doc_id, unique and not null; text) of Jaccard `similarity` or more, whose
    components are those of all such links. Texts without words link with nothing."""
    parts = partitions(single.sparkSession)
    groups, alone = _candidates(single, shingle, similarity)
    width = math.log(1 / similarity) * 1.001  # a little over, for rounding
    placed = groups.select(F.col("node").alias("doc_id"), "component", F.floor(F.log(F.col("n").cast("double")) / width).cast("int").alias("band"), (F.col("n") + DOC_COST).alias("cost"))
    placed = saved(placed, "placed")
    bands = placed.groupBy("component", "band").agg(F.count("*").alias("docs"), F.ceil(F.sum("cost") / chunk).cast("int").alias("g"))
    bands = saved(bands, "bands")
    above = bands.select("component", (F.col("band") - 1).alias("band"), F.col("g").alias("above"))
    below = bands.select("component", (F.col("band") + 1).alias("band"), F.col("g").alias("below"))
    shape = saved(bands.join(above, ["component", "band"], "left").join(below, ["component", "band"], "left"), "shape")
    rows = placed.join(shape, ["component", "band"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("g")).cast("int"))
    # sides: 0 a chunk with itself, 1 and 2 the two chunks of other tiles; of two bands the lower one is 1
    count = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda band, i, j, up, side: F.struct(band.alias("tile_band"), i.alias("i"), j.alias("j"), F.lit(up).alias("up"), side.cast("int").alias("side"))
    band, own = F.col("band"), F.col("own")
    inside = F.transform(F.when(F.col("docs") > 1, count(F.col("g"))).otherwise(F.array().cast("array<int>")), lambda y: tile(band, F.least(own, y), F.greatest(own, y), False, F.when(own == y, 0).when(own < y, 1).otherwise(2)))
    upward = F.transform(count(F.col("above")), lambda y: tile(band, own, y, True, F.lit(1)))
    downward = F.transform(count(F.col("below")), lambda y: tile(band - 1, y, own, True, F.lit(2)))
    tiles = rows.select("doc_id", "component", F.explode(F.concat(inside, upward, downward)).alias("t")).select("doc_id", "component", "t.*")
    ids = placed.select("doc_id").unionByName(alone.select(F.col("a").alias("doc_id"))).unionByName(alone.select(F.col("b").alias("doc_id")))
    sets = saved(single.join(ids, "doc_id", "left_semi").mapInArrow(partial(_sets, shingle=shingle), "doc_id long, tokens array<long>"), "sets")
    full = tiles.join(sets, "doc_id").repartition(parts, "component", "tile_band", "i", "j", "up")
    links = full.groupBy("component", "tile_band", "i", "j", "up").applyInArrow(on_group(_tile, similarity=similarity), "a long, b long")
    return links.unionByName(_compared(alone, sets, similarity))
