"""Result caches and leases over streams, in the order of event time, with expiry.

Rows of a key wait in state until the watermark has passed them, so rows that come out of order are worked on in order and
the outcome does not depend on arrival, on batches or on restarts: it is that of a replay of the whole log. Rows later than
the watermark allows are dropped by Spark. What has expired leaves the state by a timer.
"""

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quirefold.operators.folds import folded

#: Seconds that a result is kept, and after which a silent worker counts as gone.
CACHE_TTL, LIVENESS_TTL = 14 * 24 * 3600, 45

CACHE_OUT = "key string, event_id bigint, outcome string, value string"
_WAITING = "rows array<struct<event_id: bigint, action: string, value: string, requested: string, served: string>>"


def cached(state: dict, row: dict, ttl: float) -> str:
    """The outcome of one call at a cache whose state is `value` and `until`: stored or refused, hit or miss."""
    if row["action"] == "put":
        if row["requested"] is None or row["requested"] != row["served"]:  # another model answered than the key names
            return "refused"
        state["value"], state["until"] = row["value"], row["ts"] + ttl
        return "stored"
    return "hit" if row["ts"] < state["until"] else "miss"


def cache_replay(log: DataFrame, ttl: float = CACHE_TTL) -> DataFrame:
    """log (key, ts in seconds, event_id, action put or get, value, requested, served) with outcome, in order of ts and event_id."""

    def step(state: dict, row: dict) -> str:
        return cached(state, row, ttl)

    return folded(log, ["key"], ["ts", "event_id"], lambda: {"value": None, "until": float("-inf")}, step, "outcome", "string")


class ResultCache(StatefulProcessor):
    """A cache of results by key: a put counts if the model asked for served it; a get finds the last put of less than `ttl` seconds ago."""

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint", _WAITING)
        self.held = handle.getValueState("held", "value string, until bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new: dict[int, list] = {}
        for row in rows:
            new.setdefault(round(row["ts"].timestamp() * 1000), []).append((row["event_id"], row["action"], row["value"], row["requested"], row["served"]))
        for at, some in new.items():
            before = [tuple(x) for x in self.waiting.getValue((at,))[0]] if self.waiting.containsKey((at,)) else []
            self.waiting.updateValue((at,), (before + some,))
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        held = self.held.get() if self.held.exists() else None
        state = {"value": held[0], "until": held[1] / 1000} if held else {"value": None, "until": float("-inf")}
        out = []
        if self.waiting.containsKey((at,)):
            for event_id, action, value, requested, served in sorted(tuple(x) for x in self.waiting.getValue((at,))[0]):
                outcome = cached(state, {"action": action, "ts": at / 1000, "value": value, "requested": requested, "served": served}, self.ttl)
                out.append(Row(key=key[0], event_id=event_id, outcome=outcome, value=state["value"] if outcome == "hit" else None))
            self.waiting.removeKey((at,))
        if state["until"] <= at / 1000:
            self.held.clear()
        elif not held or state != {"value": held[0], "until": held[1] / 1000}:
            until = round(state["until"] * 1000)
            self.held.update((state["value"], until))
            self.handle.registerTimer(until)
        return iter(out)

    def close(self) -> None:
        pass


def cache_stream(log: DataFrame, ttl: float = CACHE_TTL, delay: str = "10 minutes") -> DataFrame:
    """cache_replay over a stream (ts a timestamp): key, event_id, outcome and the value found. Rows may be `delay` late.

    Needs the RocksDB state store.
    """
    return log.withWatermark("ts", delay).groupBy("key").transformWithState(ResultCache(ttl), CACHE_OUT, "append", "EventTime")


class Leases(StatefulProcessor):
    """Tells of each key when it comes to life and when it has been silent for `timeout` seconds."""

    def __init__(self, timeout: float):
        self.timeout = round(timeout * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")
        self.waiting = handle.getMapState("waiting", "at bigint", "n int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for at in {round(row["ts"].timestamp() * 1000) for row in rows}:
            self.waiting.updateValue((at,), (1,))
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None and at - last >= self.timeout:
            out.append(Row(key=key[0], state="gone", at=last + self.timeout))
            self.last.clear()
            last = None
        if self.waiting.containsKey((at,)):
            self.waiting.removeKey((at,))
            if last is None:
                out.append(Row(key=key[0], state="alive", at=at))
            self.last.update((at,))
            self.handle.registerTimer(at + self.timeout)
        return iter(out)

    def close(self) -> None:
        pass


def liveness_stream(beats: DataFrame, timeout: float = LIVENESS_TTL, delay: str = "1 minute") -> DataFrame:
    """key, state (alive or gone) and at (milliseconds) over a stream of heartbeats (key, ts a timestamp).

    A key that beats exactly at its end is gone and alive again. Needs the RocksDB state store.
    """
    return beats.select("key", "ts").withWatermark("ts", delay).groupBy("key").transformWithState(Leases(timeout), "key string, state string, at bigint", "append", "EventTime")


def liveness_replay(beats: DataFrame, timeout: float = LIVENESS_TTL) -> DataFrame:
    """liveness_stream over a whole log; of the last beat only what is known at the log's end: nothing."""
    from pyspark.sql import Window as W

    order = W.partitionBy("key").orderBy("ms")
    ms = beats.select("key", F.unix_millis("ts").alias("ms")).distinct()
    gap = ms.withColumn("before", F.lag("ms").over(order)).withColumn("lapsed", F.col("ms") - F.col("before") >= round(timeout * 1000))
    alive = gap.where("before IS NULL OR lapsed").select("key", F.lit("alive").alias("state"), F.col("ms").alias("at"))
    return alive.unionByName(gap.where("lapsed").select("key", F.lit("gone").alias("state"), (F.col("before") + round(timeout * 1000)).alias("at")))
