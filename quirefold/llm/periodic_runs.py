"""Periodic runs of words, by a harmonic grid of longest-common-extension queries.

A stretch of words with period p and at least three periods long covers some grid points jp, (j+1)p and (j+2)p, so for each
p only the points jp are asked: how far do the words from jp and from (j+1)p on agree, forward and backward? Both answers
are range minima over the common prefixes of neighbours in a suffix array, one of the words and one of the reversed words.
Over all p these are n/1 + n/2 + n/3 + ... queries, and those whose first words differ have the answer nought.

Many documents share one suffix array: a mark of its own after each keeps extensions within their document.
"""

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grid points that are looked at together.
_SLICE = 1 << 20
#: Bytes of text that share a suffix array; a longer text has one of its own.
_PART = 1 << 20

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


class Extensions:
    """Longest common prefixes of any two suffixes of a sequence whose last symbol occurs once.

    The suffixes are sorted by doubling: ranks by the first 2^k symbols come from two ranks by 2^(k-1), and only suffixes
    that still share a rank are sorted again. All ranks together give the common prefixes of neighbours. Some 4 bytes a
    symbol and doubling are held, for as many doublings as the longest repeat needs, and as much for the range minima.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.rank = np.searchsorted(np.sort(symbols), symbols).astype(np.int32)  # how many suffixes are smaller
        ranks, step = [self.rank], 1
        todo = np.flatnonzero(np.bincount(self.rank, minlength=n)[self.rank] > 1)
        while len(todo):
            key = self.rank[todo].astype(np.int64) * (n + 1) + np.where(todo + step < n, self.rank[np.minimum(todo + step, n - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            todo, key = todo[order], key[order]
            old = self.rank[todo]
            at = np.arange(len(todo))
            began = lambda x: np.maximum.accumulate(np.where(np.concatenate(([True], x[1:] != x[:-1])), at, 0))
            first = began(key)
            self.rank = self.rank.copy()
            self.rank[todo] = old + first - began(old)
            ranks.append(self.rank)
            todo = todo[np.bincount(first, minlength=len(first))[first] > 1]
            step *= 2
        order = np.empty(n, dtype=np.int64)
        order[self.rank] = np.arange(n)
        common = np.zeros(max(n - 1, 1), dtype=np.int32)
        like = np.flatnonzero(ranks[0][order[:-1]] == ranks[0][order[1:]])
        a, b, length = order[like], order[like + 1], np.zeros(len(like), dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            length += (ranks[k][a + length] == ranks[k][b + length]).astype(np.int64) << k
        common[like] = length
        del ranks
        self.least, width = [common], 1
        while 2 * width <= len(common):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree from i and from j on; i and j differ everywhere."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(low), dtype=np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k)])
        return out


def _grid(symbols: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grid points, their periods) at which three words in a row of the grid are equal, a slice of periods at a time."""
    most = np.maximum(size // 3, 0)
    doc = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = (size[doc] - 1) // period - 1
    ends = np.cumsum(points)
    at = 0
    while at < len(doc):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, side="right")))
        n = points[at:upto]
        p = np.repeat(period[at:upto], n)
        where = np.repeat(first[doc[at:upto]], n) + (np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)) * p
        same = symbols[where] == symbols[where + p]
        where, p = where[same], p[same]
        same = symbols[where + p] == symbols[where + 2 * p]
        yield where[same], p[same]
        at = upto


def find_runs(docs: list[np.ndarray], least: int, times: int) -> tuple[np.ndarray, Runs]:
    """(index of the document, (start, length, period)) of all runs, by document, start and period. docs: ids of words."""
    size = np.array([len(x) for x in docs], dtype=np.int64)
    first = 1 + np.cumsum(size + 1) - (size + 1)
    words = 1 + max((int(x.max()) for x in docs if len(x)), default=0)
    symbols = np.empty(1 + int(size.sum()) + len(docs), dtype=np.int64)
    symbols[0] = words
    for k, (x, at) in enumerate(zip(docs, first.tolist(), strict=True)):
        symbols[at : at + len(x)] = x
        symbols[at + len(x)] = words + 1 + k
    # stretches by their ends, with the smallest of the periods that give them
    found = np.zeros((3, 0), dtype=np.int64)
    forward = backward = None
    for where, p in _grid(symbols, first, size):
        if len(where):
            if forward is None:
                forward, backward = Extensions(symbols), Extensions(symbols[::-1])
            end = where + p + forward.common(where, where + p)
            start = where - backward.common(len(symbols) - where, len(symbols) - where - p)
            long = end - start >= np.maximum(least, times * p)
            found = np.concatenate([found, np.array([start, end, p])[:, long]], axis=1)
            found = found[:, np.lexsort((found[2], found[1], found[0]))]
            new = np.ones(found.shape[1], dtype=bool)
            new[1:] = (found[:2, 1:] != found[:2, :-1]).any(axis=0)
            found = found[:, new]
    doc = np.searchsorted(first, found[0], side="right") - 1
    start, length, period = found[0] - first[doc], found[1] - found[0], found[2]
    order = np.lexsort((period, start, doc))
    return doc[order], (start[order], length[order], period[order])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PART, side="right")) - at)
        yield batch.slice(at, n)
        at += n


def _with_runs(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = [c for c in batch.schema.names if c not in ("runs", "collapsed")]
        for part in _parts(batch):
            words = [(x.as_py() or b"").split() for x in part["text"].cast(pa.binary())]
            ids = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode().indices.to_numpy()
            ends = np.cumsum([len(x) for x in words])
            doc, (start, length, period) = find_runs(np.split(ids, ends[:-1]), least, times)
            begin = np.searchsorted(doc, np.arange(len(words) + 1))
            for k in np.unique(doc).tolist():
                own = slice(begin[k], begin[k + 1])
                cover = np.zeros(len(words[k]) + 1, dtype=np.int64)
                np.add.at(cover, start[own] + period[own], 1)
                np.add.at(cover, start[own] + length[own], -1)
                words[k] = [w for w, c in zip(words[k], np.cumsum(cover[:-1]).tolist(), strict=True) if not c]
            told = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), told)
            collapsed = pa.array([b" ".join(x) for x in words], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(part[c] for c in rest), runs, collapsed], [*rest, "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """docs with runs (array of start, length, period by start, then period) and collapsed (the text without repetitions).

    docs: text; all columns are kept, but those named runs and collapsed are replaced. Words are runs of characters other
    than space and \\t \\n \\v \\f \\r, numbered from 0. A run is a stretch of words with smallest period q, at least
    max(least, times * q) words long, that no neighbouring word extends with period q; times is 3 or more. Runs may overlap.
    collapsed leaves out every word that lies in a run after that run's first period, and joins the others by one space.

    A null, empty or blank text has no runs and an empty collapsed text. Repeated rows are documents of their own. Words are
    compared as they are, by exact ids, not by hashes. Rows need no shuffle; a task holds some 200 bytes a word of a
    mebibyte of texts, or of its longest text.
    """
    if times < 3:
        raise ValueError("a run has three periods at least")
    docs = docs.drop("runs", "collapsed").withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(partial(_with_runs, least=least, times=times), f"{schema}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
