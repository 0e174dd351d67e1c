"""Substring deduplication by fixed-block anchors.

A passage of `window` words that occurs twice contains, in the earlier document, one whole block of
`block = (window + 1) // 2` words that starts at a multiple of `block`. So the non-overlapping blocks of all documents
are the reference index, every rolling window of `block` words is a probe, and a hit is extended in both directions:
around each shared block all windows of `window` words are compared, which joined up are the maximal exact repeats.

Documents are dealt by a hash of doc_id into groups of a few megabytes. A group sends each distinct block or window
once, as bytes sorted by hash and packed by bucket of the hash, so a passage in a third of all documents costs one entry
a group. A bucket answers with one bit an entry; which entry a bit stands for follows from the group's own texts.
"""

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import hashing
from quirefold.llm.common import WORD, on_group, on_groups, partitions

U = np.uint64
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string"


class _Group:
    """The texts of one group, by doc_id, as word hashes; rows without a doc_id take no part in windows."""

    def __init__(self, docs: pa.Table, window: int, buckets: int):
        ids, texts = docs["doc_id"].to_pylist(), docs["text"].cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] or b"" for i in order]
        self.window, self.block, self.buckets = window, (window + 1) // 2, buckets
        self.words, self.owner = hashing.hashed(self.texts)
        self.doc = np.array([x or 0 for x in self.ids], dtype=np.int64)
        self.absent = np.array([x is None for x in self.ids], dtype=bool)
        self.first = np.searchsorted(self.owner, np.arange(len(self.ids)))

    def valid(self, n: int) -> np.ndarray:
        """Which positions start a window of n words inside one document."""
        if len(self.words) < n:
            return np.zeros(0, dtype=bool)
        owner = self.owner[: len(self.words) - n + 1]
        return (owner == self.owner[n - 1 :]) & ~self.absent[owner]

    def distinct(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the positions `at`: their order by bucket and hash, where each distinct hash starts in it, its bucket."""
        bucket = ((hashes >> U(34)) % U(self.buckets)).astype(np.int64)
        order = np.argsort(hashes, kind="stable")  # positions are in order already
        order = order[np.argsort(bucket[order].astype(np.uint16 if self.buckets < 1 << 16 else np.int64), kind="stable")]
        h, b = hashes[order], bucket[order]
        starts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])))) if len(h) else np.zeros(0, dtype=np.int64)
        return order, starts, b[starts]

    @cached_property
    def blocks(self) -> tuple:
        at = np.flatnonzero(self.valid(self.block))
        h = hashing.windows(self.words, self.block)[at]
        order, starts, bucket = self.distinct(h, at)
        return at, (h[order[starts]] & U(0x3FFFFFFF)).astype("<u4"), order, starts, bucket

    def block_entries(self) -> tuple[np.ndarray, np.ndarray]:
        """One entry of 32 bits for each distinct block: 30 of its hash, is it a reference block, has it two documents."""
        at, low, order, starts, bucket = self.blocks
        if not len(starts):
            return bucket, np.zeros(0, dtype="<u4")
        owner = self.owner[at[order]]
        fixed = np.logical_or.reduceat((at[order] - self.first[owner]) % self.block == 0, starts)
        doc = self.doc[owner]
        several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        return bucket, low << 2 | fixed.astype("<u4") << 1 | several.astype("<u4")

    def anchored(self, bits: np.ndarray) -> np.ndarray:
        """The positions of windows that hold a shared block."""
        at, _, order, starts, _ = self.blocks
        hit = np.zeros(len(self.words) + self.window, dtype=np.int32)
        hit[at[order[np.repeat(bits, np.diff(np.append(starts, len(order))))]]] = 1
        reach = np.concatenate(([0], np.cumsum(hit)))
        ok = np.flatnonzero(self.valid(self.window))
        span = self.window - self.block + 1
        return ok[reach[ok + span] > reach[ok]]

    def windows(self, at: np.ndarray) -> tuple:
        h = hashing.windows(self.words, self.window)[at] if len(at) else np.zeros(0, dtype=np.uint64)
        order, starts, bucket = self.distinct(h, at)
        least = self.doc[self.owner[at[order][starts]]]  # positions are by doc_id
        return h, order, starts, bucket, least

    def window_entries(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.anchored(bits)
        h, order, starts, bucket, least = self.windows(at)
        out = np.zeros(len(starts), dtype=[("h", "<u8"), ("x", "<u2"), ("doc", "<i8")])
        if len(starts):
            out["h"], out["doc"] = h[order][starts], least
            out["x"] = hashing.windows(self.words, self.window, 1)[at[order][starts]] >> U(48)
        return bucket, out

    def removed(self, at: np.ndarray, found: tuple, earlier: np.ndarray) -> np.ndarray:
        """Which words a window covers that starts in a smaller document too; at, found: anchored windows, sorted out."""
        _, order, starts, _, least = found
        size = np.diff(np.append(starts, len(order)))
        gone = at[order[np.repeat(earlier, size) | (self.doc[self.owner[at[order]]] > np.repeat(least, size))]]
        step = np.zeros(len(self.words) + self.window + 1, dtype=np.int32)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + self.window, -1)
        return np.cumsum(step)[: len(self.words)] > 0


def _planes(a: np.ndarray) -> bytes:
    """The bytes of all entries by significance, which lets the shuffle's codec drop the empty ones."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _entries(data: bytes, kind: np.dtype) -> np.ndarray:
    n = len(data) // kind.itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def _sent(g: int, bucket: np.ndarray, entries: np.ndarray) -> pa.Table:
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, dtype=np.int64)
    ends = np.append(cuts[1:], len(bucket))[: len(cuts)]
    data = [_planes(entries[a:b]) for a, b in zip(cuts, ends, strict=True)]
    return pa.table({"bucket": pa.array(bucket[cuts].astype(np.int32)), "g": pa.array([g] * len(cuts), pa.int32()), "data": pa.array(data, pa.binary())})


_ENTRY = {1: np.dtype("<u4"), 2: np.dtype([("h", "<u8"), ("x", "<u2"), ("doc", "<i8")])}


def _answer(rows: pa.Table, step: int) -> pa.Table:
    """One bucket's answers: for each group one bit an entry."""
    parts = [_entries(x, _ENTRY[step]) for x in rows["data"].to_pylist()]
    sizes = [len(x) for x in parts]
    all_ = np.concatenate(parts)
    if step == 1:
        key = all_ >> 2
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        size = np.diff(np.append(starts, len(order)))
        fixed = np.maximum.reduceat(all_[order] >> 1 & 1, starts) > 0
        several = (np.maximum.reduceat(all_[order] & 1, starts) > 0) | (size > 1)
        bit = np.repeat(fixed & several, size)
    else:
        order = np.lexsort((all_["doc"], all_["x"], all_["h"]))
        s = all_[order]
        starts = np.flatnonzero(np.concatenate(([True], (s["h"][1:] != s["h"][:-1]) | (s["x"][1:] != s["x"][:-1]))))
        bit = s["doc"] > np.repeat(s["doc"][starts], np.diff(np.append(starts, len(order))))
    out = np.zeros(len(all_), dtype=bool)
    out[order] = bit
    cut = np.split(out, np.cumsum(sizes)[:-1])
    keep = [i for i, x in enumerate(cut) if x.any()]
    at = pa.array(keep, pa.int64())
    return pa.table({
        "g": rows["g"].take(at), "step": pa.array([step] * len(keep), pa.int32()), "bucket": rows["bucket"].take(at),
        "bits": pa.array([np.packbits(cut[i]).tobytes() for i in keep], pa.binary()),
    })


def _bits(answers: pa.Table, step: int, bucket: np.ndarray) -> np.ndarray:
    """The bits of a group's entries, whose buckets are given in order."""
    out = np.zeros(len(bucket), dtype=bool)
    for s, b, bits in zip(answers["step"].to_pylist(), answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
        if s == step:
            lo, hi = np.searchsorted(bucket, b), np.searchsorted(bucket, b, side="right")
            out[lo:hi] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=hi - lo)
    return out


def _probe(docs: pa.Table, window: int, buckets: int) -> pa.Table:
    return _sent(docs["g"][0].as_py(), *_Group(docs, window, buckets).block_entries())


def _extend(docs: pa.Table, answers: pa.Table, window: int, buckets: int) -> pa.Table:
    if not docs.num_rows or not answers.num_rows:
        return _sent(0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_ENTRY[2]))
    group = _Group(docs, window, buckets)
    return _sent(docs["g"][0].as_py(), *group.window_entries(_bits(answers, 1, group.blocks[4])))


def _cut(docs: pa.Table, answers: pa.Table, window: int, buckets: int) -> pa.Table:
    if not docs.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "spans": pa.array([], _SPANS), "kept_text": pa.array([], pa.string())})
    group = _Group(docs, window, buckets)
    gone = np.zeros(len(group.words), dtype=bool)
    if answers.num_rows:
        bits = _bits(answers, 1, group.blocks[4])
        at = group.anchored(bits)
        found = group.windows(at)
        gone = group.removed(at, found, _bits(answers, 2, found[3]))
    ends = np.append(group.first[1:], len(group.words))
    spans, kept = [], []
    for text, a, b in zip(group.texts, group.first, ends, strict=True):
        words, cut = text.split(), gone[a:b]
        if cut.any():
            turn = np.flatnonzero(np.diff(np.concatenate(([False], cut, [False])).astype(np.int8)))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(turn[::2], turn[1::2], strict=True)])
            words = [w for w, x in zip(words, cut.tolist(), strict=True) if not x]
        else:
            spans.append([])
        kept.append(b" ".join(words))
    total = np.concatenate(([0], np.cumsum(gone)))
    return pa.table({
        "doc_id": pa.array(group.ids, pa.int64()), "n_words": pa.array((ends - group.first).astype(np.int64)),
        "n_removed": pa.array((total[ends] - total[group.first]).astype(np.int64)), "spans": pa.array(spans, _SPANS),
        "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
    })


def substring_dedup(docs: DataFrame, window: int = 13, group_bytes: int = 12 << 20) -> DataFrame:
    """Removes words covered by a window of `window` words that starts in a document with a smaller doc_id too.

    docs: doc_id (integer), text; other columns are ignored. Windows are judged on the input. Returns one row for each
    input row: doc_id, n_words, n_removed, spans (removed runs of words, half-open), kept_text (kept words joined by one
    space). A null or empty text has no words. Rows that share a doc_id are not compared with each other; a row whose
    doc_id is null keeps all words and removes none elsewhere. Hashes decide: 64 + 16 bits beside the bucket's.

    group_bytes: about how much text a group holds at most. The number of groups, and of buckets, follows from the size of
    all texts, so a task's memory does not grow with the data; a single text may be larger than a group.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # where texts are few, at least a megabyte each, so that all tasks get some
    groups = max(-(-size // group_bytes), min(partitions(docs.sparkSession), -(-size >> 20)), 1)
    dealt = rows.where("doc_id is not null").withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    own = {"window": window, "buckets": groups}
    sent, answered = "bucket int, g int, data binary", "g int, step int, bucket int, bits binary"
    probes = dealt.groupBy("g").applyInArrow(on_group(_probe, **own), sent)
    shared = probes.groupBy("bucket").applyInArrow(on_group(_answer, step=1), answered)
    around = dealt.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(on_groups(_extend, **own), sent)
    earlier = around.groupBy("bucket").applyInArrow(on_group(_answer, step=2), answered)
    cut = dealt.groupBy("g").cogroup(shared.unionByName(earlier).groupBy("g")).applyInArrow(on_groups(_cut, **own), _OUT)
    words = F.coalesce(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    nameless = rows.where("doc_id is null").select("doc_id", F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array_join(words, " ").alias("kept_text"))
    return cut.unionByName(nameless)
