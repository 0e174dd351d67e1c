"""Divergence of sources within a language, by sketch-prefiltered counting.

Most terms are too rare to matter, and they make most of the rows that a count would shuffle. So document frequencies go
first into a count-min sketch: every distinct term of a document adds one to a cell in each of a few rows, and the cells of
all tasks are added up. A term's smallest cell is never under its true frequency, so a term that misses the limit in any
cell is impossible and is dropped where it is read. Only survivors are shuffled, counted exactly, and held to the limit again.

Sources are compared by sparse pair joins: two sources differ in a term that neither holds by the same amount for every such
term, so only terms that one or both hold are joined.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.llm import hashing
from quirefold.llm.common import on_group, saved

U = np.uint64
#: Rows of the sketch.
DEPTH = 3
#: Bits of a row's number of cells: one cell for so many bytes of text, within bounds. All rows as bits take 48 MB at most.
_BYTES_A_CELL, _LEAST_BITS, _MOST_BITS = 256, 16, 27
#: Cells whose bits travel together.
_BLOCK_BITS = 15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_TERM = np.zeros(256, dtype=bool)
_TERM[ord("a") : ord("z") + 1] = True
_TERM[0x80:] = True
_SCALE = 1_000_000_000


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, first row, rows, lower-case bytes, term starts, term ends, each term's row in the run) for runs of texts."""
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch["text"].cast(pa.binary())]
        for first, buf, offsets in hashing.chunks(texts):
            low = _LOWER[buf]
            edge = np.zeros(len(low) + 2, dtype=bool)
            edge[1:-1] = _TERM[low]
            turn = np.flatnonzero(edge[1:] != edge[:-1])
            starts, ends = turn[::2], turn[1::2]
            yield batch, first, len(offsets), low, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _key_of(text: str) -> int:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return int(hashing.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]) if len(raw) else 0


def _keys(batch: pa.RecordBatch, first: int, n: int, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A hash of each term and its document's language."""
    salt = np.array([_key_of(x) for x in batch["lang"].slice(first, n).to_pylist()], dtype=np.uint64)
    return hashing.mix(hashing.word_hashes(low, starts, ends) + salt[owner])


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (hashing.mix(keys + U(row * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U(64 - bits)).astype(np.int64) | row << bits


def _sketched(batches: Iterator[pa.RecordBatch], bits: int, held: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(cell, n): how many of the task's documents add to a cell, summed up over `held` keys at a time."""
    keys, counts = [], []

    def told() -> Iterator[pa.RecordBatch]:
        if keys:
            k, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(back, np.concatenate(counts), len(k)).astype(np.int64)
            for row in range(DEPTH):
                yield pa.RecordBatch.from_arrays([pa.array(_cells(k, row, bits)), pa.array(n)], ["cell", "n"])

    for batch, first, n, low, starts, ends, owner in _texts(batches):
        h = _keys(batch, first, n, low, starts, ends, owner)
        order = np.lexsort((h, owner))
        h, doc = h[order], owner[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        k, c = np.unique(h[new], return_counts=True)
        keys.append(k)
        counts.append(c)
        if sum(map(len, keys)) > held:
            yield from told()
            keys, counts = [], []
    yield from told()


def _as_bits(rows: pa.Table) -> pa.Table:
    """The cells of one block as a bit map."""
    full = np.zeros(1 << _BLOCK_BITS, dtype=bool)
    full[rows["cell"].to_numpy() & ((1 << _BLOCK_BITS) - 1)] = True
    return pa.table({"block": rows["block"].slice(0, 1), "bits": pa.array([np.packbits(full).tobytes()], pa.binary())})


def sketch(docs: DataFrame, limit: int, bits: int) -> np.ndarray:
    """The bit map of all cells of the merged sketch that hold `limit` or more; docs: lang, text, without nulls.

    The driver gets DEPTH * 2^bits / 8 bytes at most, whatever the number of terms.
    """
    cells = docs.select("lang", "text").mapInArrow(partial(_sketched, bits=bits), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= limit)
    blocks = cells.select(F.shiftright("cell", _BLOCK_BITS).alias("block"), "cell").groupBy("block").applyInArrow(on_group(_as_bits), "block long, bits binary")
    whole = np.zeros((DEPTH << bits) >> 3, dtype=np.uint8)
    for block, packed in blocks.collect():
        whole[block << (_BLOCK_BITS - 3) : (block + 1) << (_BLOCK_BITS - 3)] = np.frombuffer(packed, dtype=np.uint8)
    return whole


def _counted(batches: Iterator[pa.RecordBatch], full: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the terms that the sketch cannot rule out, for each run of texts."""
    for batch, first, n, low, starts, ends, owner in _texts(batches):
        keys = _keys(batch, first, n, low, starts, ends, owner)
        maybe = np.ones(len(keys), dtype=bool)
        for row in range(DEPTH):
            at = np.flatnonzero(maybe)
            cell = _cells(keys[at], row, bits)
            maybe[at] = (full[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 != 0
        starts, ends, owner = starts[maybe], ends[maybe], owner[maybe]
        # the terms themselves, as one array over the bytes that belong to them
        mark = np.zeros(len(low) + 1, dtype=np.int8)
        mark[starts] += 1
        mark[ends] -= 1
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[np.cumsum(mark[:-1]) > 0].tobytes())])
        coded = terms.dictionary_encode()
        term, size = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
        groups = pa.StructArray.from_arrays([batch["lang"].slice(first, n), batch["source"].slice(first, n)], ["lang", "source"])
        names: dict[tuple, int] = {}
        group = np.array([names.setdefault((x["lang"], x["source"]), len(names)) for x in groups.to_pylist()], dtype=np.int64)
        pair, times = np.unique(owner * size + term, return_counts=True)  # a document and a term
        both, back = np.unique(group[pair // size] * size + pair % size, return_inverse=True)
        known = list(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array([known[g][0] for g in (both // size).tolist()], pa.string()), pa.array([known[g][1] for g in (both // size).tolist()], pa.string()), coded.dictionary.take(pa.array(both % size)).cast(pa.string()),
             pa.array(np.bincount(back, times, len(both)).astype(np.int64)), pa.array(np.bincount(back, minlength=len(both)).astype(np.int64))], ["lang", "source", "term", "n", "docs"],
        )


def _share(count: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (N + 5 V)), in whole numbers of up to 38 digits."""
    whole = lambda c: c.cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", F.lit(_SCALE).cast("decimal(10,0)") * (whole(count) + 5), whole(F.col("total")) + 5 * whole(F.col("kept")))).cast("long")


def divergence(docs: DataFrame, limit: int = 30, top: int = 50) -> DataFrame:
    """How the sources of each language differ in their terms: lang, source, part, item, value (long), rank (int).

    docs: text, lang, source, nulls as empty; other columns are ignored. Terms are runs of letters a to z and of characters
    beyond ASCII; only A to Z are lower-cased. A language keeps its terms in at least `limit` of its documents. Each of the
    groups (lang, source) and each language gives a kept term with count c the share p = 1 + floor(10^9 (c + 5) / (N + 5 V)),
    with V kept terms and N their count there. Part pair: for each other source of the language the sum of the differences of
    shares over all kept terms, all ranks; with no kept terms 0. Part term: kept terms that a group holds and gives a
    larger share than its language does, by the difference, up to rank `top`. Ranks go by value, then by item (UTF-8).
    Repeated rows are documents of their own. All arithmetic is in whole numbers.

    The sketch's width follows the bytes of text up to 2^27 cells a row, at which it rules out most terms of some 10^12
    bytes; beyond, more terms pass it and are shuffled, and results stay exact. Rows of results: the square of the number
    of a language's sources, by definition.
    """
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    docs = docs.select(text, lang, source)
    groups = saved(docs.groupBy("lang", "source").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")), "groups")
    size = groups.agg(F.sum("bytes")).first()[0] or 0
    bits = min(max((size // _BYTES_A_CELL).bit_length(), _LEAST_BITS), _MOST_BITS)
    full = sketch(docs, limit, bits)
    counted = docs.mapInArrow(partial(_counted, full=full, bits=bits), "lang string, source string, term string, n long, docs long")
    counted = saved(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counted")
    terms = saved(counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= limit).drop("docs"), "terms")
    cells = saved(counted.drop("docs").join(terms, ["lang", "term"]), "cells")

    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = saved(groups.withColumn("none", F.when(F.col("kept") > 0, _share(F.lit(0))).otherwise(0)), "shares")
    known = groups.select("lang", "source", "total", "kept", "none", "lang_total")
    cells = saved(cells.join(known, ["lang", "source"]).withColumn("p", _share(F.col("n"))), "cells")

    over = cells.withColumn("total", F.col("lang_total")).withColumn("value", F.col("p") - _share(F.col("all"))).where("value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    # a term counts |p_a - p_b|; all terms are first counted as if in neither source, then those of either, then of both
    a, b = (known.select("lang", F.col("source").alias(x), F.col("none").alias(f"none_{x}"), *(["kept"] if x == "a" else [])) for x in "ab")
    pairs = a.join(b, "lang").where("a <> b")
    neither = F.abs(F.col("none_a") - F.col("none_b"))
    # of a's terms only their distinct shares meet the other sources
    spread = cells.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("n"))
    lone = spread.join(known.select("lang", F.col("source").alias("b"), F.col("none").alias("none_b")), "lang").where("a <> b").join(known.select("lang", F.col("source").alias("a"), F.col("none").alias("none_a")), ["lang", "a"])
    lone = lone.groupBy("lang", "a", "b").agg(F.sum(F.col("n") * (F.abs(F.col("p") - F.col("none_b")) - neither)).alias("v"))
    left, right = (cells.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"p_{x}"), F.col("none").alias(f"none_{x}")) for x in "ab")
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b")
    both = both.agg(F.sum(F.abs(F.col("p_a") - F.col("p_b")) - F.abs(F.col("p_a") - F.col("none_b")) - F.abs(F.col("none_a") - F.col("p_b")) + neither).alias("v"))
    turned = lambda df: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "v")
    parts = pairs.select("lang", "a", "b", (F.col("kept") * neither).alias("v")).unionByName(lone).unionByName(turned(lone)).unionByName(both).unionByName(turned(both))
    apart = parts.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("v").alias("value"))
    apart = apart.withColumn("rank", F.row_number().over(by)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return apart.select(*columns).unionByName(over.select(*columns))
