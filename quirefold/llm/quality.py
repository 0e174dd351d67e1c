"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams: single words and pairs of words, runs of one to three word shapes, and of up to three
marks of whether a word repeats the one before. Each is hashed into one of 2^18 places. An indicator is scaled by the log
ratio of its smoothed counts in the two classes, rows are brought to length one, and a linear hinge-loss model is fitted
by dual coordinate descent. A logistic curve, fitted on rows left out of that, turns margins into scores.
"""

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import hashing
from quirefold.llm.common import saved

_PLACES = 18
#: How often the bits of a place above the lowest 16 rise.
_RISES = (1 << _PLACES - 16) - 1
U = np.uint64
#: The features of training come to the driver by so many bytes, as packed.
PIECE = 2 << 20
#: What a byte is in a word's shape; runs of one kind count once.
_SHAPE = np.zeros(256, dtype=np.uint8)
_SHAPE[:] = np.arange(256)
_SHAPE[ord("a") : ord("z") + 1], _SHAPE[ord("A") : ord("Z") + 1], _SHAPE[ord("0") : ord("9") + 1], _SHAPE[128:] = ord("a"), ord("A"), ord("0"), ord("a")


def _grams(words: np.ndarray, owner: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = hashing.mix(hashing.windows(words, n) + U(salt)) >> U(64 - _PLACES)
    own = owner[: len(words) - n + 1] == owner[n - 1 :]
    return h[own], owner[: len(words) - n + 1][own]


def features(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, distinct features of its run of texts, their text within the run)."""
    for at, buf, offsets in hashing.chunks(texts):
        starts, ends = hashing.word_bounds(buf)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        words = hashing.word_hashes(buf, starts, ends)
        kind = _SHAPE[buf]
        first = np.ones(len(kind), dtype=bool)
        first[1:] = kind[1:] != kind[:-1]
        first[starts] = True
        place = np.concatenate(([0], np.cumsum(first)))
        shapes = hashing.word_hashes(kind[first], place[starts], place[ends])
        again = np.ones(len(words), dtype=np.uint64)
        again[1:] += (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        found = [_grams(words, owner, 1, 1), _grams(words, owner, 2, 2), *(_grams(shapes, owner, n, 2 + n) for n in (1, 2, 3)), *(_grams(again, owner, n, 5 + n) for n in (1, 3))]
        both = np.unique(np.concatenate([x.astype(np.int64) | o << _PLACES for x, o in found]))
        yield at, both & ((1 << _PLACES) - 1), both >> _PLACES


def packed(row: np.ndarray) -> bytes:
    """Sorted features in two bytes each: where their upper bits rise, then all lower ones."""
    if not len(row):
        return b""
    return np.searchsorted(row, np.arange(1, 1 + _RISES) << 16).astype("<u4").tobytes() + (row & 0xFFFF).astype("<u2").tobytes()


class Packed(Sequence):
    """Rows of features, each unpacked where it is asked for."""

    def __init__(self, rows: list[bytes]):
        self.low = [np.frombuffer(x, dtype="<u2", offset=4 * _RISES) if x else np.zeros(0, dtype="<u2") for x in rows]
        self.rises = [np.frombuffer(x, dtype="<u4", count=_RISES).tolist() if x else [] for x in rows]

    def __len__(self) -> int:
        return len(self.low)

    def __getitem__(self, i: int) -> np.ndarray:
        out = self.low[i].astype(np.int32)
        for at in self.rises[i]:
            out[at:] += 1 << 16
        return out


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch["text"].cast(pa.binary())]
        rows = [b""] * len(texts)
        for at, feature, owner in features(texts):
            ends = np.searchsorted(owner, np.arange(len(texts) - at + 1))
            for i in np.unique(owner).tolist():
                rows[at + i] = packed(feature[ends[i] : ends[i + 1]])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(rows, pa.binary())], ["doc_id", "label", "features"])


def fit(rows: Sequence[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 20, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(weights, ratios, bias, slope, shift): the score of a row is the logistic of slope * margin + shift."""
    places = 1 << _PLACES
    if not len(rows) or labels.min() == labels.max():
        rate = float(labels.mean()) if len(rows) else 0.5
        return np.zeros(places), np.ones(places), 0.0, 0.0, float(np.log((rate + 0.01) / (1.01 - rate)))
    held = np.arange(len(rows)) % 5 == 0
    counts = np.zeros((2, places), dtype=np.int64)
    for r, y, h in zip(rows, labels, held, strict=True):
        if not h:
            np.add.at(counts[y], r, 1)
    counts = smooth + counts
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    lengths = np.array([np.sqrt((ratios[r] ** 2).sum()) or 1.0 for r in rows])
    w, bias, alpha = np.zeros(places), 0.0, np.zeros(len(rows))
    own = np.flatnonzero(~held)
    y = np.where(labels == 1, 1.0, -1.0)
    per = {c: 0.5 * len(own) / max(1, (y[own] == c).sum()) for c in (-1.0, 1.0)}
    top = cost * np.array([per[c] for c in y.tolist()])
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(own).tolist():
            r = rows[i]
            x = ratios[r] / lengths[i]
            g = y[i] * (w[r] @ x + bias) - 1  # the row's length is one, and one more for the bias
            new = min(max(alpha[i] - g / 2, 0.0), top[i])
            if step := new - alpha[i]:
                alpha[i] = new
                w[r] += step * y[i] * x
                bias += step * y[i]
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    m = np.array([w[rows[i]] @ ratios[rows[i]] / lengths[i] + bias for i in np.flatnonzero(held)])
    slope, shift, t = 1.0, 0.0, (labels[held] == 1).astype(float)
    for _ in range(50):  # Newton's steps for the logistic curve
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
        v, e = p * (1 - p) + 1e-6, p - t
        h = np.array([[(v * m * m).sum() + 1e-2, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-2]])
        d = np.linalg.solve(h, [(e * m).sum() + 1e-2 * (slope - 1), e.sum() + 1e-2 * shift])
        slope, shift = slope - d[0], shift - d[1]
        if np.abs(d).max() < 1e-6:
            break
    return w, ratios, bias, float(max(slope, 1e-3)), float(shift)


def margins(texts: list[bytes], weights: np.ndarray, squares: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(texts), bias)
    for at, feature, owner in features(texts):
        n = int(owner[-1]) + 1 if len(owner) else 0
        total, length = np.bincount(owner, weights[feature], n), np.bincount(owner, squares[feature], n)
        out[at : at + n] += total / np.sqrt(np.where(length > 0, length, 1.0))
    return out


def _scored(batches: Iterator[pa.RecordBatch], weights: np.ndarray, squares: np.ndarray, bias: float, slope: float, shift: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m = margins([x.as_py() or b"" for x in batch["text"].cast(pa.binary())], weights.astype(np.float64), squares.astype(np.float64), bias)
        score = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
        rest = [c for c in batch.schema.names if c != "score"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(score)], [*rest, "score"])


def train(docs: DataFrame, labels: DataFrame, rows: int = 8000, megabytes: int = 256) -> tuple:
    """Fits the model on at most `rows` labelled documents of at most `megabytes` of features, those whose hash of doc_id is
    smallest.

    labels: doc_id, quality (0 or 1; other values and nulls are left out). The caller leaves out held-out ids. Of rows that
    share a doc_id the one whose text has the smallest hash is taken. The bounds are what keeps the fit in the driver's
    memory, where features come by pieces and stay packed; whatever else is counted or scored covers all documents.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("s")).select("doc_id", "label", "s.text")
    found = saved(texts.mapInArrow(_training_rows, "doc_id long, label int, features binary"), "features").withColumn("h", F.xxhash64("doc_id"))
    sizes = found.select("doc_id", "h", F.octet_length("features").alias("bytes")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])  # at most `rows`
    ends = np.cumsum(sizes["bytes"].to_numpy())
    unpacked = 2 * np.maximum(sizes["bytes"].to_numpy() - 4 * _RISES, 0)
    fit_in = int(np.searchsorted(np.cumsum(unpacked), megabytes << 20, side="right"))
    chosen, hashes, piece = set(sizes["doc_id"].to_pylist()[:fit_in]), sizes["h"].to_numpy()[:fit_in], ends[:fit_in] // PIECE
    got = {}
    for k in np.unique(piece).tolist():
        own = hashes[piece == k]
        part = found.where(F.col("h").between(int(own[0]), int(own[-1]))).select("doc_id", "label", "features").toArrow()
        got |= {i: (y, x) for i, y, x in zip(*(c.to_pylist() for c in part.columns), strict=True) if i in chosen}
    rows_of = [got[i] for i in sorted(got)]
    order = np.random.Generator(np.random.PCG64(3)).permutation(len(rows_of))
    return fit(Packed([rows_of[i][1] for i in order]), np.array([y for y, _ in rows_of], dtype=np.int64)[order])


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """docs with score, the likelihood of label 1; a null or empty text has the score of a text without features.

    All columns are kept but one named score, which is replaced. Only the text is read by the model.
    """
    weights, ratios, bias, slope, shift = model
    own = {"weights": (weights * ratios).astype(np.float32), "squares": (ratios**2).astype(np.float32), "bias": bias, "slope": slope, "shift": shift}
    rest = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    return rest.mapInArrow(partial(_scored, **own), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rest.schema.fields)}, score double")


def held_out(doc_id):
    """Whether a document's labels are kept from training: crc32 of its id as text leaves remainder 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
