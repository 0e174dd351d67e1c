"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks. Every pair of a query block and a candidate block is scored, and a query's scores are
counted in a histogram over the range they can have. The histograms are added up over all blocks; the bin that holds the
k-th best score becomes the next, finer range, until a bin is one score wide. Then the scores above the k-th are kept,
and of those equal to it the smallest ids, as many as are missing.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.llm.common import on_group, on_groups, saved

_BINS = 1 << 14
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_EXACT = float(1 << 53)


def _pack(rows: pa.Table) -> pa.Table:
    """A block's vectors as bytes of the smallest type that holds all components; floors of doubles are doubles."""
    rows = rows.sort_by([("vec_id", "ascending")])
    q = rows["q"].combine_chunks()
    flat = (q.chunk(0) if isinstance(q, pa.ChunkedArray) else q).flatten().to_numpy(zero_copy_only=False)
    most = np.abs(flat).max()
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return pa.table({
        "dim": rows["dim"].slice(0, 1), "block": rows["block"].slice(0, 1), "kind": pa.array([kind]), "ids": pa.array([rows["vec_id"].to_pylist()], pa.list_(pa.int64())), "data": pa.array([flat.astype(kind).tobytes()], pa.binary()),
    })


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; what a long cannot hold becomes its smallest or largest value."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)  # every sum is exact
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, _LOW, _HIGH).astype(np.int64)


def _tile(left: pa.Table, right: pa.Table, k: int, step: str) -> pa.Table:
    """For a pair of blocks: the bins (step count) or the rows (step take) of each query that can matter.

    A block with k scores above a bin settles that the k-th best is not below, so lower bins of it are left out.
    """
    out: list[list] = [[], [], []]
    if left.num_rows and right.num_rows:
        row = left.to_pylist()[0] | right.to_pylist()[0]
        a, b = (np.frombuffer(row[f"{x}_data"], dtype=row[f"{x}_kind"]).reshape(-1, row["dim"]) for x in "qc")
        s = _scores(a, b)
        ids = np.array(row["c_ids"], dtype=np.int64)
        for i, q in enumerate(row["q_ids"]):
            other, lo, width = np.ones(len(ids), dtype=bool), row["lo"][i], row["width"][i]
            for c in np.flatnonzero(ids == q).tolist():  # the query's own row, once
                if (a[i] == b[c]).all():
                    other[c] = False
                    break
            if step == "count":
                mine = s[i][other & (s[i] >= lo)]
                bins = np.minimum((mine - np.int64(lo)).view(np.uint64) // np.uint64(width), np.uint64(_BINS)).astype(np.int64)  # the difference may need 64 bits
                full, counts = np.unique(bins, return_counts=True)
                full, counts = full[::-1], counts[::-1]
                most = int(np.searchsorted(np.cumsum(counts), k)) + 1
                new = (np.full(len(full[:most]), q), full[:most], counts[:most])
            else:
                at = np.flatnonzero(other & (s[i] >= lo))
                best = at[np.lexsort((ids[at], -s[i][at].astype(object) if s[i].min() == _LOW else -s[i][at]))[:k]]
                new = (np.full(len(best), q), ids[best], s[i][best])
            for column, values in zip(out, new, strict=True):
                column.append(values)
    names = ("query_id", "bin", "n") if step == "count" else ("query_id", "vec_id", "score")
    return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64()) for x in out], names=list(names))


def exact_top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, query_block: int = 2048, block: int = 4096) -> DataFrame:
    """The k best candidates of every query by integer inner product.

    vectors: vec_id (integer), embedding (array of numbers); other columns are ignored. is_query: a Column over vec_id.
    Each component x becomes floor(scale * x), x as double. Returns query_id, rank (from 1), vec_id, score; fewer than k
    rows if there are fewer candidates; ties go to the smaller vec_id. A query is no candidate of its own. Vectors that
    are null, empty, or hold null or non-finite components, and rows without vec_id, take no part; queries meet only
    vectors of their own length. Rows that repeat a vec_id count as candidates each, also for a query of that id, which
    leaves out one row only, its own; as a query the id counts once, by its smallest vector. All scores that a long holds
    are exact; others become its smallest or largest value. A component that scaled leaves the doubles counts as the
    largest double.

    Memory of a task: query_block * block scores. Every score is computed in each of the few rounds and none is kept.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: F.least(F.greatest(x * scale, F.lit(-sys.float_info.max)), F.lit(sys.float_info.max))
    # the floor as a double: whole already from 2^52 on
    whole = F.transform("v", lambda x: F.when(F.abs(scaled(x)) < 2.0**52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    rows = saved(rows.where(sound).select("vec_id", F.size("v").alias("dim"), whole.alias("q")), "vectors")
    packed = "dim int, block long, kind string, ids array<long>, data binary"
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "q")).alias("s")).select("vec_id", "s.dim", "s.q")
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("nq"))

    def blocks(df: DataFrame, n: str, most: int) -> DataFrame:
        count = F.ceil(F.greatest(F.col(n), F.lit(1)) / most)
        return df.join(sizes.select("dim", count.alias("blocks")), "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).groupBy("dim", "block").applyInArrow(on_group(_pack), packed)

    candidates = saved(blocks(rows, "n", block).select("dim", F.col("block").alias("c"), F.col("kind").alias("c_kind"), F.col("ids").alias("c_ids"), F.col("data").alias("c_data")), "candidates")
    queries = saved(blocks(asked, "nq", query_block).select("dim", F.col("block").alias("b"), F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "queries")
    # every score lies within the product of the largest lengths, and within a long
    longest = lambda df: df.agg(F.max(F.sqrt(F.aggregate("q", F.lit(0.0), lambda acc, x: acc + x * x))).alias("m")).first()["m"] or 0.0
    bound = longest(asked) * longest(rows)
    bound = min(_HIGH, int(bound * (1 + 1e-9)) + 1) if bound < 1e300 else _HIGH
    width = -(-(2 * bound + 1) // _BINS)
    state = asked.select("vec_id", F.lit(-bound - (bound == _HIGH)).cast("long").alias("lo"), F.lit(width).cast("long").alias("width"))

    def scored(state: DataFrame, step: str, schema: str) -> DataFrame:
        where = queries.select("b", "dim", F.posexplode("q_ids").alias("at", "vec_id")).join(state, "vec_id").groupBy("dim", "b").agg(F.sort_array(F.collect_list(F.struct("at", "lo", "width"))).alias("s"))
        asked = queries.join(where, ["dim", "b"]).select("dim", "b", "q_kind", "q_ids", "q_data", F.col("s.lo").alias("lo"), F.col("s.width").alias("width"))
        pairs = asked.select("dim", "b").join(candidates.select("dim", "c"), "dim")  # ids of blocks only
        left, right = pairs.join(asked, ["dim", "b"]), pairs.join(candidates, ["dim", "c"])
        right = right.select(*(F.col(c).alias(f"{c}_") if c in ("dim", "b", "c") else F.col(c) for c in right.columns))
        return left.groupBy("dim", "b", "c").cogroup(right.groupBy("dim_", "b_", "c_")).applyInArrow(on_groups(_tile, k=k, step=step), schema)

    while True:
        counts = scored(state, "count", "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("query_id").orderBy(F.desc("bin"))
        seen = counts.withColumn("above", F.sum("n").over(down) - F.col("n")).join(state.withColumnRenamed("vec_id", "query_id"), "query_id")
        last = F.max(F.when(F.col("above") < k, F.struct(-F.col("bin"), "lo", "width"))).alias("s")
        low = F.col("s.lo").cast("decimal(19,0)") - F.col("s.col1").cast("decimal(6,0)") * F.col("s.width").cast("decimal(19,0)")
        state = seen.groupBy("query_id").agg(last).select(F.col("query_id").alias("vec_id"), low.cast("long").alias("lo"), F.lit(max(1, -(-width // _BINS))).cast("long").alias("width"))
        state = saved(state, "state")
        if width == 1:
            break
        width = max(1, -(-width // _BINS))
    kept = scored(state, "take", "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
