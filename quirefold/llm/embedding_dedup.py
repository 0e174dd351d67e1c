"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a key, the signs of its products with random directions, written one after the other.
Vectors are ordered lexicographically by key, and each is compared with the next `width` in that order. Where more than
`width` vectors agree on the first bits of their keys, as a large group of near copies does, the whole run is compared, in
tiles of bounded size. The passes use other directions, and what they find is united.

Pairs are never written out. Every vector carries its place in all passes, so a pair that an earlier pass has compared is
known as such and counts once; a block or tile returns only each vector's number of new links and a forest of them.
"""

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.llm.common import on_group, saved
from quirefold.llm.components import connected_components

_BITS = 48
_FOUND = "rep long, links long, root long"


def prefix_bits(n: int, width: int) -> int:
    """So many first bits that n vectors without close ones share them with less than a window of others."""
    return min(_BITS, max(0, math.ceil(math.log2(max(1.0, 4 * n / width)))))


def passes_for(n: int, width: int, threshold: float, recall: float = 0.9) -> int:
    """How many passes a pair at the threshold itself needs to share its first bits in one with likelihood `recall`."""
    same = (1 - math.acos(threshold) / math.pi) ** prefix_bits(n, width)
    return max(8, math.ceil(math.log(1 - recall) / math.log1p(-same))) if same < 1 else 8


def _keys(batches: Iterator[pa.RecordBatch], passes: int) -> Iterator[pa.RecordBatch]:
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        column, rep = batch["v"], batch["rep"].to_numpy()
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
        dims = np.diff(ends)
        parts = []
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            if dim not in planes:
                planes[dim] = np.random.Generator(np.random.PCG64(dim)).standard_normal((passes * _BITS, dim))
            v = flat[ends[own][:, None] + np.arange(dim)]
            signs = ((v / np.abs(v).max(axis=1, keepdims=True)) @ planes[dim].T > 0).reshape(len(own), passes, _BITS)
            keys = signs @ (1 << np.arange(_BITS - 1, -1, -1, dtype=np.int64))
            parts.append((np.tile(np.arange(passes), len(own)), np.full(len(own) * passes, dim), keys.reshape(-1), np.repeat(rep[own], passes)))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] or [np.zeros(0)] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["pass", "dim", "key", "rep"])


def _matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    a = column.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(a), -1)


def _units(column: pa.ChunkedArray) -> np.ndarray:
    v = _matrix(column, np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class _Forest:
    """Components of rows by their numbers: of each the smallest."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, i: np.ndarray, j: np.ndarray, ok: np.ndarray) -> None:
        """Unites rows i and columns j where the matrix ok has a link."""
        while True:
            apart = ok & (self.label[i][:, None] != self.label[j][None, :])
            rows = np.flatnonzero(apart.any(axis=1))
            if not len(rows):
                return
            for a, b in zip(self.label[i[rows]].tolist(), self.label[j[apart[rows].argmax(axis=1)]].tolist(), strict=True):
                while self.label[a] != a:
                    a = self.label[a]
                while self.label[b] != b:
                    b = self.label[b]
                self.label[max(a, b)] = min(a, b)
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def _close(rows: pa.Table, width: int, shift: int, threshold: float) -> pa.Table:
    """Counts and unites the close pairs of a window's block, or of a tile of a run.

    A block (side 0: own rows; side 1: rows of the next blocks) takes pairs at most `width` ranks apart that start in an
    own row. A tile (dense; side 1: rows of a later part of the run) takes pairs of the run that are further apart. Pairs
    that a pass before has compared are left out.
    """
    rows = rows.sort_by([("side", "ascending"), ("rank", "ascending")])
    p, dense, side = rows["pass"][0].as_py(), rows["dense"][0].as_py(), rows["side"].to_numpy()
    rep, n, v = rows["rep"].to_numpy(), rows["n"].to_numpy().astype(np.float64), _units(rows["v"])
    ranks, heads = _matrix(rows["ranks"], np.int64), _matrix(rows["keys"], np.int64) >> shift
    links, forest, own = np.zeros(len(rep)), _Forest(len(rep)), int((side == 0).sum())
    for at in range(0, own, 256):
        i = np.arange(at, min(at + 256, own))
        begin = (at if own == len(rep) else own) if dense else at
        j = np.arange(begin, len(rep) if dense else min(at + 256 + width, len(rep)))
        ok = v[i] @ v[j].T >= threshold
        if ok.any():
            ahead = ranks[j, p][None, :] - ranks[i, p][:, None]
            ok &= (ahead > width) & (heads[i, p][:, None] == heads[j, p][None, :]) if dense else (ahead > 0) & (ahead <= width)
        for q in range(p):
            if ok.any():
                ok &= (np.abs(ranks[i, q][:, None] - ranks[j, q][None, :]) > width) & (heads[i, q][:, None] != heads[j, q][None, :])
        if ok.any():
            links[i] += ok @ n[j]
            links[j] += n[i] @ ok
            forest.unite(i, j, ok)
    some = np.flatnonzero(links > 0)
    return pa.table({"rep": pa.array(rep[some], pa.int64()), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(rep[forest.label[some]], pa.int64())})


def close_links(distinct: DataFrame, threshold: float, passes: int | None, width: int, block: int) -> DataFrame:
    """rep, links, root: parts of the number of vectors that each rep links with, and links that join its component.

    distinct: rep, n (how many vectors are equal to it), v.
    """
    size = distinct.count()
    passes = passes or passes_for(size, width, threshold)
    shift = _BITS - prefix_bits(size, width)
    keys = distinct.select("rep", "v").mapInArrow(partial(_keys, passes=passes), "pass int, dim int, key long, rep long")
    # the global rank: sort, number each partition's rows, and add what the partitions before it hold; ties by a hash of the pass
    tie = F.xxhash64("pass", "rep")
    ordered = saved(keys.withColumn("tie", tie).repartitionByRange("pass", "dim", "key", "tie").sortWithinPartitions("pass", "dim", "key", "tie").withColumn("part", F.spark_partition_id()), "ordered")
    sizes = ordered.groupBy("pass", "dim", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("pass", "dim").orderBy("part")) - F.col("n")).drop("n")
    own = W.partitionBy("pass", "dim", "part").orderBy("key", "tie")
    ranked = ordered.withColumn("row", F.row_number().over(own)).join(before, ["pass", "dim", "part"])
    ranked = saved(ranked.select("pass", "dim", "rep", "key", (F.col("row") + F.col("before") - 1).alias("rank")), "ranked")
    places = ranked.groupBy("rep", "dim").agg(F.sort_array(F.collect_list(F.struct("pass", "rank", "key"))).alias("at"))
    placed = saved(distinct.join(places, "rep").select("rep", "n", "dim", "v", F.col("at.rank").alias("ranks"), F.col("at.key").alias("keys")), "placed")
    each = placed.select("rep", "n", "dim", "v", "ranks", "keys", F.posexplode("ranks").alias("pass", "rank")).withColumn("head", F.shiftrightunsigned(F.element_at("keys", F.col("pass") + 1), shift))
    columns = ["pass", "dim", "head", "lo", "hi", "dense", "side", "rank", "rep", "n", "v", "ranks", "keys"]
    # each block also gets the first rows of the next ones, as many as a window is wide
    reach = F.floor(F.greatest(F.col("rank") - width, F.lit(0)) / block)
    blocks = each.withColumn("hi", F.floor(F.col("rank") / block)).withColumn("lo", F.explode(F.sequence(reach, F.col("hi"))))
    blocks = blocks.withColumn("side", (F.col("lo") != F.col("hi")).cast("int")).withColumns({"hi": F.lit(-1).cast("long"), "head": F.lit(-1).cast("long"), "dense": F.lit(False)})
    parts = blocks.select(columns)
    runs = saved(ranked.groupBy("pass", "dim", F.shiftrightunsigned("key", shift).alias("head")).agg(F.count("*").alias("size"), F.min("rank").alias("first")).where(F.col("size") > width + 1), "runs")
    if not runs.isEmpty():
        tile = F.greatest(F.lit(1024), F.least(F.lit(8192), F.floor(F.lit(1 << 22) / F.col("dim"))))
        dense = each.join(runs, ["pass", "dim", "head"]).withColumn("part", F.floor((F.col("rank") - F.col("first")) / tile))
        dense = dense.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / tile))))
        dense = dense.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other"), "side": (F.col("part") > F.col("other")).cast("int"), "dense": F.lit(True)})
        parts = parts.unionByName(dense.select(columns))
    return parts.groupBy("pass", "dim", "dense", "head", "lo", "hi").applyInArrow(on_group(_close, width=width, shift=shift, threshold=threshold), _FOUND)


def embedding_dedup(vectors: DataFrame, threshold: float = 0.95, passes: int | None = None, width: int = 1024, block: int = 4096) -> DataFrame:
    """Links vectors of cosine `threshold` or more and names their components.

    vectors: vec_id (integer), embedding (array of numbers); other columns are ignored. Returns one row for each input
    row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id that links reach, itself
    included), kept (is it that one). Vectors that are null, empty, zero, or hold null or non-finite components, and rows
    without vec_id, link with nothing; vectors of other length never link. Equal vectors are one class: links are found
    between classes, and all members count. No pair below the threshold links. Without `passes` their number grows with
    the number of vectors, so that a pair at the threshold itself is compared with a likelihood of 0.9 at least, and closer
    ones with a higher one; no group is too large. The work for a group of m vectors that share the first bits of their
    keys grows with the square of m, since each pair may link; memory does not.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"  # floats stay as small as they are
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    sound = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(kind[6:-1])).otherwise(x))  # -0.0 is 0.0
    keyed = saved(rows.withColumn("ok", F.coalesce(sound, F.lit(False))).select("vec_id", F.when(F.col("ok"), plain).alias("v")), "vectors")
    distinct = saved(keyed.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    found = saved(close_links(distinct, threshold, passes, width, block), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    named = saved(distinct.join(links, "rep", "left").join(parts, "rep", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "named")
    sound_ones = keyed.where("v is not null").join(named, "v").select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    others = keyed.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return sound_ones.unionByName(others).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
