"""The bootstrap over all events."""

import math
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quirefold.operators import statistics
from quirefold.plans import catalog

D = "/root/testdata/sf0.001"


def test_interval_of_all_events(spark):
    got = {r.event_type: (r.low, r.high) for r in catalog.QUERIES["d13_bootstrap"](spark, D).collect()}
    v = F.log(1 + F.col("value"))
    for r in spark.read.parquet(f"{D}/events.parquet").groupBy("event_type").agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.count(v).alias("n")).collect():
        half = 1.96 * r.s / math.sqrt(r.n)
        low, high = map(math.log, got[r.event_type])
        assert abs(low - (r.m - half)) < 0.3 * half and abs(high - (r.m + half)) < 0.3 * half


def test_draws_are_those_of_the_definition_and_quick():
    """Each row's draws follow from its hash; several times as quick as by searching the steps for each."""
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**64, 1 << 20, dtype=np.uint64).reshape(1024, 1024)
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
    edges = np.array([int(x * 2**53) + k << 11 for x in steps if x < 1 for k in (-1, 0, 1) if int(x * 2**53) + k < 2**53], dtype=np.uint64)
    h[0, : len(edges)] = edges
    poisson, took = statistics._Poisson(), []
    for _ in range(5):
        began = time.perf_counter()
        got = poisson.draw(h, np.empty_like(h))
        middle = time.perf_counter()
        want = np.searchsorted(steps, (h >> np.uint64(11)).astype(np.float64) / 2**53, side="right")
        took.append((middle - began, time.perf_counter() - middle))
        assert (got == want).all()
    assert min(a for a, _ in took) < 0.8 * min(b for _, b in took)
    batch = pa.RecordBatch.from_pydict({"key": ["a", None, "a", "b"], "mark": [1, -5, 3, 2**62], "v": [0.5, 1.0, -2.0, 3.0]})
    out = {r["key"][0].as_py(): (r["n"].to_numpy(), r["t"].to_numpy()) for r in statistics._weighted_sums([batch], 2500, 7)}
    draws = statistics._mix(np.arange(1, 2501, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
    w = np.searchsorted(steps, (statistics._mix(batch["mark"].to_numpy().view(np.uint64)[:, None] ^ draws) >> np.uint64(11)) / 2**53, side="right")
    assert set(out) == {"a", None, "b"} and (out["a"][0] == w[0] + w[2]).all() and (out[None][0] == w[1]).all()
    assert np.allclose(out["a"][1], 0.5 * w[0] - 2.0 * w[2]) and np.allclose(out["b"][1], 3.0 * w[3])
