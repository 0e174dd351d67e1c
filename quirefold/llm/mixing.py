"""Mixing sources to target weights along a curriculum.

Every source has a schedule: its weight over the course of training, piecewise linear over [0, 1]. The integral of the
schedule is the source's share. A source's documents, in an order fixed by a hash, form a stream of words that is read
up to the source's target, again and again if that is larger than the source. The word at offset c of a target T gets the
position at which the schedule's cumulative demand, scaled to T, reaches c; documents are range-sorted by position.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.llm.common import partitions, word_count

Schedule = Sequence[tuple[float, float]]
#: Weights that integrate to 5, 2 and 1: the first kind of source leads at the start, the others gain towards the end.
DEFAULT: tuple[Schedule, ...] = (((0.0, 8.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 0.5), (1.0, 1.5)))


def _cumulative(schedule: Schedule) -> list[float]:
    sums = [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        sums.append(sums[-1] + (t1 - t0) * (w0 + w1) / 2)
    return sums


def _checked(schedules: Sequence[Schedule]) -> None:
    for s in schedules:
        times = [t for t, _ in s]
        if len(s) < 2 or times[0] != 0 or times[-1] != 1 or times != sorted(set(times)) or min(w for _, w in s) < 0 or _cumulative(s)[-1] <= 0:
            raise ValueError(f"a schedule rises in time from 0 to 1, with weights that are not negative and not all zero: {s}")


def source_targets(docs: DataFrame, schedules: Sequence[Schedule] = DEFAULT, cap: float = 3.0) -> DataFrame:
    """source, source_size, which (index of its schedule) and target (words) of every source of docs (source, size).

    Sources in order of code points, null last, take the schedules in turn. Targets share the sum of all sizes by the
    integrals of the schedules; none exceeds `cap` times its source's size, and what is over is shared again by weight
    until none is above. Only the few rows of sources are ordered.
    """
    _checked(schedules)
    sources = docs.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    shares = F.array(*(F.lit(_cumulative(s)[-1]) for s in schedules))
    ranked = sources.withColumn("which", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(schedules))
    ranked = ranked.withColumn("weight", F.element_at(shares, F.col("which") + 1)).withColumn("most", cap * F.col("source_size"))
    # by what a unit of weight may get: sources below the common level are full, the others get the level times weight
    by = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_first())
    total = F.sum("source_size").over(W.partitionBy(F.lit(0))).cast("double")
    full = F.coalesce(F.sum("most").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("level", (total - full) / left)
    fits = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct((F.col("most") / F.col("weight")).alias("r"), F.col("level")))).over(W.partitionBy(F.lit(0)))
    level = F.coalesce(fits["level"], F.lit(float("inf")))
    return ranked.withColumn("target", F.least(F.col("most"), level * F.col("weight"))).select("source", "source_size", "which", "target")


def _position(fraction: Column, which: Column, schedules: Sequence[Schedule]) -> Column:
    """The time at which a schedule has dealt out a fraction of its integral."""
    knots = F.element_at(
        F.array(*(F.array(*(F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w"), F.lit(c).alias("c")) for (t, w), c in zip(s, _cumulative(s), strict=True))) for s in schedules)), which + 1
    )
    due = fraction * F.element_at(knots, -1)["c"]
    at = F.least(F.greatest(F.size(F.filter(knots, lambda k: k["c"] <= due)), F.lit(1)), F.size(knots) - 1)
    a, b = F.element_at(knots, at), F.element_at(knots, at + 1)
    rest, slope = due - a["c"], (b["w"] - a["w"]) / (b["t"] - a["t"])
    root = a["w"] + F.sqrt(F.greatest(a["w"] * a["w"] + 2 * slope * rest, F.lit(0.0)))
    return F.least(a["t"] + F.when(root > 0, 2 * rest / root).otherwise(0.0), b["t"])


def mix(docs: DataFrame, schedules: Sequence[Schedule] = DEFAULT, cap: float = 3.0, seed: int = 0) -> DataFrame:
    """docs with size, source_size, target, copies, taken (size * copies) and positions (of each copy, in [0, 1]).

    docs: doc_id, text, source; all columns are kept, except that those named like a result are replaced. The size is the
    number of words; null or empty texts have 0 and are taken once where their source's turn reaches them. No copies
    means that the mix leaves the document out; none is taken over `cap` times, rounded up. A source's taken words differ from its
    target by less than one document. Order within a source: MD5 of seed and doc_id (of the text where that is null), then
    doc_id, size and a hash of the text, so reruns agree, whatever the partitions; repeated rows are documents of their
    own. A null source is a source.

    The running sum over a source is made in two steps: within ranges of the hash, and over the sums of ranges, so that
    the rows of a large source are in as many tasks as there are shuffle partitions.
    """
    sized = docs.withColumn("size", word_count(F.col("text").cast("string")))
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken", "positions")]
    sources = source_targets(sized, schedules, cap)
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    spread = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), named)), F.lit(15)), 16, 10).cast("long")  # 60 bits
    width = -(-(1 << 60) // partitions(docs.sparkSession))
    dealt = sized.withColumn("_hash", spread).withColumn("_text", F.xxhash64(F.col("text").cast("string"))).withColumn("_block", F.expr(f"cast(_hash div {width} AS int)"))
    sums = dealt.groupBy("source", "_block").agg(F.sum("size").alias("in_block"))
    before = sums.withColumn("_before", F.sum("in_block").over(W.partitionBy("source").orderBy("_block")) - F.col("in_block"))
    before = before.select(F.col("source").alias("_s"), F.col("_block").alias("_b"), "_before")
    placed = before.join(sources.withColumnRenamed("source", "_s2"), F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2")
    own = W.partitionBy("source", "_block").orderBy("_hash", "doc_id", "size", "_text")
    dealt = dealt.withColumn("_own", F.sum("size").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    dealt = dealt.select(*keep, "size", "_own", "_block").join(placed, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    start = F.col("_own") + F.col("_before")
    turns = F.ceil((F.col("target") - start) / F.col("source_size"))
    dealt = dealt.withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.greatest(turns, F.lit(0)), F.lit(math.ceil(cap)))).otherwise(1).cast("int"))
    turn = lambda k: F.when(F.col("target") > 0, (start + k * F.col("source_size")) / F.col("target")).otherwise(0.0)
    positions = F.transform(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>")), lambda k: _position(turn(k), F.col("which"), schedules))
    dealt = dealt.withColumn("positions", positions)
    return dealt.select(*keep, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "positions")


def training_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each copy that mix() takes, range-sorted by position; the given columns only."""
    copies = mixed.select(*columns, F.explode("positions").alias("_position"))
    return copies.repartitionByRange(partitions(mixed.sparkSession), "_position", "doc_id").sortWithinPartitions("_position", "doc_id").select(*columns)
