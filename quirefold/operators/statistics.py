"""Exact statistics of evaluation runs."""

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def distribution(value: str) -> list[Column]:
    """n, median, min and max of a column's values, to three places; nulls are left out."""
    return [F.count(value).alias("n"), F.round(F.percentile(value, F.lit(0.5)), 3).alias("median"), F.round(F.min(value), 3).alias("min"), F.round(F.max(value), 3).alias("max")]


def pearson(x: str, y: str) -> Column:
    """Pearson's r to six places; null below three pairs or without variance on a side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    n, vx, vy = F.count(F.when(both, 1)), F.var_pop(F.when(both, F.col(x))), F.var_pop(F.when(both, F.col(y)))
    covariance = F.covar_pop(x, y)
    return F.round(F.when((n >= 3) & (vx > 0) & (vy > 0), covariance / F.sqrt(vx * vy)), 6)


def geometric_mean(value: str) -> Column:
    return F.exp(F.avg(F.log(value)))


def only_match(samples: DataFrame, events: DataFrame) -> DataFrame:
    """samples (id, key, started, finished) with tokens of the event of their key in between, if exactly one is."""
    hit = samples.join(events.withColumnRenamed("key", "_k"), (F.col("key") == F.col("_k")) & F.col("ts").between(F.col("started"), F.col("finished")), "left")
    return hit.groupBy("id").agg(F.count("ts").alias("n_matches"), F.max("tokens").alias("_t")).select("id", "n_matches", F.when(F.col("n_matches") == 1, F.col("_t")).alias("tokens"))


def _mixed(h: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """_mix in place."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        np.right_shift(h, np.uint64(33), out=scratch)
        np.bitwise_xor(h, scratch, out=h)
        np.multiply(h, np.uint64(factor), out=h)
    np.right_shift(h, np.uint64(33), out=scratch)
    return np.bitwise_xor(h, scratch, out=h)


class _Poisson:
    """Poisson(1) of 64-bit hashes: how many of the distribution's steps are at most the hash's first 53 bits as a fraction.

    The first 16 bits tell it at once but for the few values that a step lies within.
    """

    def __init__(self):
        self.steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
        first, last = np.arange(1 << 16) / 2**16, (np.arange(1 << 16) + 1) / 2**16 - 2.0**-53
        low = np.searchsorted(self.steps, first, side="right")
        self.table, self.open = low.astype(np.float64), low != np.searchsorted(self.steps, last, side="right")
        self.table[self.open] = -1

    def draw(self, h: np.ndarray, scratch: np.ndarray) -> np.ndarray:
        np.right_shift(h, np.uint64(48), out=scratch)
        w = self.table[scratch.view(np.int64)]
        if (at := np.flatnonzero(w.reshape(-1) < 0)).size:
            u = (h.reshape(-1)[at] >> np.uint64(11)).astype(np.float64) / 2**53
            w.reshape(-1)[at] = np.searchsorted(self.steps, u, side="right")
        return w


#: Rows and rounds that are drawn together, so what is made of them stays in a core's cache.
_ROWS, _ROUNDS = 64, 1024


def _weighted_sums(batches: Iterator[pa.RecordBatch], rounds: int, seed: int) -> Iterator[pa.RecordBatch]:
    """By key the sums over rows (key, mark, v) of w and w * v for each round, w being Poisson(1) drawn by mark and round."""
    poisson = _Poisson()
    draws = _mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    sums: dict = {}
    for batch in batches:
        marks, v = batch["mark"].to_numpy().view(np.uint64), batch["v"].to_numpy(zero_copy_only=False)
        keys = batch["key"].dictionary_encode()
        owners = pc.fill_null(keys.indices, -1).to_numpy(zero_copy_only=False)
        for n, key in [(-1, None), *enumerate(keys.dictionary.to_pylist())]:
            at = np.flatnonzero(owners == n)
            if not len(at):
                continue
            total = sums.setdefault(key, np.zeros((2, rounds)))
            for lo in range(0, len(at), _ROWS):
                part = at[lo : lo + _ROWS]
                own = np.stack([np.ones(len(part)), v[part]])
                for r in range(0, rounds, _ROUNDS):
                    h = marks[part][:, None] ^ draws[None, r : r + _ROUNDS]
                    scratch = np.empty_like(h)
                    total[:, r : r + _ROUNDS] += own @ poisson.draw(_mixed(h, scratch), scratch)
    for key, (n, t) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([key] * rounds, pa.string()), pa.array(range(rounds), pa.int32()), pa.array(n), pa.array(t)], ["key", "r", "n", "t"])


def bootstrap_interval(values: DataFrame, key: str, value: str, rounds: int = 1000, seed: int = 1, row: str = "event_id") -> DataFrame:
    """The 2.5 % and 97.5 % order statistics of resampled geometric means, by key.

    A row, named by `row`, counts Poisson(1) times in a round; tasks send one pair of sums for each key and round. Draws take
    much longer than reading, so rows are dealt over all cores, however few files they come from.
    """
    rows = values.select(F.col(key).cast("string").alias("key"), F.xxhash64(F.lit(seed), F.col(row)).alias("mark"), F.log(value).alias("v")).where("v is not null")
    rows = rows.repartition(2 * values.sparkSession.sparkContext.defaultParallelism, "mark")
    sums = rows.mapInArrow(partial(_weighted_sums, rounds=rounds, seed=seed), "key string, r int, n double, t double").groupBy("key", "r").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    means = sums.where("n > 0").select(F.col("key").alias(key), F.exp(F.col("t") / F.col("n")).alias("m"))
    return means.groupBy(key).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
