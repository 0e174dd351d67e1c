"""Queues, leases and limits: replay over an ordered event log, and the same state over a stream."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirefold.operators.folds import folded


def claim(queue: DataFrame, busy: DataFrame, focused: str | None = None) -> DataFrame:
    """The one pointer to serve next. queue: pos (oldest first), novel_id, chapter_index, priority, enrichment.

    Novels in busy wait. Rank is 4 for the focused novel, 2 for priority, 1 for no enrichment. Of the best rank the oldest
    pointer names the novel; within it the lowest chapter of that rank is served, unless the pointer has priority.
    """
    rank = 4 * F.coalesce((F.col("novel_id") == F.lit(focused)).cast("int"), F.lit(0)) + 2 * F.col("priority").cast("int") + (~F.col("enrichment")).cast("int")
    waiting = queue.join(busy.select("novel_id"), "novel_id", "left_anti").withColumn("rank", rank)
    best = waiting.groupBy().agg(F.max(F.struct("rank", -F.col("pos"), "novel_id", "priority")).alias("b")).select(F.col("b.rank").alias("_rank"), F.col("b.novel_id").alias("_novel"), F.col("b.priority").alias("_first"))
    same = waiting.join(F.broadcast(best), (F.col("rank") == F.col("_rank")) & (F.col("novel_id") == F.col("_novel")))  # one row
    return same.orderBy(F.when(F.col("_first"), F.col("pos")).otherwise(F.col("chapter_index")), "pos").limit(1).drop("_rank", "_novel", "_first")


def expired(beats: DataFrame, now: float, timeout: float) -> DataFrame:
    """Leases to put back: keys whose last heartbeat is `timeout` seconds old or more."""
    return beats.groupBy("key").agg(F.max("ts").alias("last")).filter(F.lit(now) - F.col("last") >= timeout)


def attempts(failures: DataFrame) -> DataFrame:
    """failures (key, ts) numbered by key, with the wait before the next try: 300 s doubled each time, 3600 s at most."""
    n = F.row_number().over(W.partitionBy("key").orderBy("ts", "event_id"))
    return failures.withColumn("attempt", n).withColumn("wait", F.least(300 * F.pow(F.lit(2.0), F.col("attempt") - 1), F.lit(3600.0)))


def cooldown(marks: DataFrame) -> DataFrame:
    """marks (key, ts, ttl) with until: the latest expiry so far; a shorter one never cuts a longer one."""
    return marks.withColumn("until", F.max(F.col("ts") + F.col("ttl")).over(W.partitionBy("key").orderBy("ts", "event_id")))


def _admit(times: list[float], state: tuple[float, int], most: int, window: float) -> tuple[list[bool], tuple[float, int]]:
    start, n = state
    out = []
    for t in times:
        if n == 0 or t - start >= window:
            start, n = t, 0
        out.append(n < most)
        n += 1 if n < most else 0
    return out, (start, n)


def limit_replay(calls: DataFrame, most: int = 10, window: float = 60.0, lease: float | None = None) -> DataFrame:
    """calls (key, ts in seconds, event_id) with allowed: at most `most` in a window that begins with its first call.

    With a lease one call is active at a time: from when it is allowed to its end (column done, null if it never tells), or
    for the lease's seconds if that is sooner; others are refused meanwhile and do not count.
    """

    def step(state: dict, row: dict) -> bool:
        t = row["ts"]
        if state["n"] == 0 or t - state["start"] >= window:
            state["start"], state["n"] = t, 0
        if state["n"] >= most or (lease is not None and t < state["until"]):
            return False
        state["n"] += 1
        if lease is not None:
            state["until"] = t + lease if row["done"] is None else min(row["done"], t + lease)
        return True

    return folded(calls, ["key"], ["ts", "event_id"], lambda: {"start": 0.0, "n": 0, "until": float("-inf")}, step, "allowed", "boolean")


def permits(log: DataFrame, capacity: int, lease: float = 180.0) -> DataFrame:
    """log (key, ts, event_id, action, reservation_id) with outcome: a reservation is granted while fewer than `capacity` are
    held, else refused; settling a held one is settled, any other late. What is not settled falls back after the lease.
    """

    def step(held: dict, row: dict) -> str:
        for old in [r for r, until in held.items() if until <= row["ts"]]:
            del held[old]
        if row["action"] == "settle":
            return "settled" if held.pop(row["reservation_id"], None) is not None else "late"
        if row["reservation_id"] in held or len(held) >= capacity:
            return "refused"
        held[row["reservation_id"]] = row["ts"] + lease
        return "granted"

    return folded(log, ["key"], ["ts", "event_id"], dict, step, "outcome", "string")


def limit_stream(calls: DataFrame, most: int = 10, window: float = 60.0) -> DataFrame:
    """limit_replay over a stream: key, event_id, allowed. The state is the window's start and count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out, now = _admit(rows["ts"].tolist(), tuple(now), most, window)
        state.update(now)
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"].to_numpy(), "allowed": out})

    return calls.groupBy("key").applyInPandasWithState(step, "key string, event_id long, allowed boolean", "start double, n int", "append", GroupStateTimeout.NoTimeout)
