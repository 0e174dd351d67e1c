"""Questions of many readers: exact gated search for all at once, and the context that each is answered from.

Questions and the chunks of their novel and vector space meet in tiles, blocks of some thousand of each, so a novel with
many chunks or many questions takes many tasks. A tile gives at most k chunks a question; the best of all tiles remain.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.operators.deal import dealt, large_keys, repeated
from quirefold.operators.versions import greedy_pack

#: Fixed value: the answer where nothing that the reader may see bears on the question.
INSUFFICIENT = "I don’t have enough information in the chapters you’ve read to answer that."
_FOUND = pa.schema([("question_id", pa.string()), ("id", pa.int64()), ("chapter_index", pa.int32()), ("distance", pa.float64())])
_EMPTY = _FOUND.empty_table()


def _vectors(rows: pa.Table, column: str, size: int) -> np.ndarray:
    return rows[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _tile(chunks: pa.Table, questions: pa.Table, k: int) -> pa.Table:
    """The k nearest chunks of a block to each question of a block, of those up to the question's chapter.

    A product of matrices finds all that may be among them; their distances are then summed in one order for every pair,
    so equal vectors are equally far.
    """
    if not chunks.num_rows or not questions.num_rows:
        return _EMPTY
    chunks = chunks.sort_by([("id", "ascending")])
    size = chunks["dim"][0].as_py()
    a, b = _vectors(questions, "q_embedding", size), _vectors(chunks, "embedding", size)
    norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    near = 1 - (a @ b.T) / np.outer(norm_a, norm_b)
    at, chapter, ids = questions["at"].to_numpy(), chunks["chapter_index"].to_numpy(), chunks["id"].to_numpy()
    out = []
    for i, name in enumerate(questions["question_id"].to_pylist()):
        seen = np.flatnonzero(chapter <= at[i])
        if len(seen) > k:
            limit = np.partition(near[i][seen], k - 1)[k - 1]
            seen = seen[near[i][seen] <= limit + 1e-9]
        exact = 1 - (b[seen] * a[i]).sum(axis=1) / np.sqrt((a[i] * a[i]).sum() * (b[seen] * b[seen]).sum(axis=1))
        best = seen[np.lexsort((ids[seen], exact))[:k]]
        order = np.sort(exact)[:k]
        out.append(pa.table([pa.array([name] * len(best), pa.string()), pa.array(ids[best], pa.int64()), pa.array(chapter[best], pa.int32()), pa.array(order)], schema=_FOUND))
    return pa.concat_tables(out)


def nearest_for_all(questions: DataFrame, chunks: DataFrame, k: int = 8, question_block: int = 1024, chunk_block: int = 8192) -> DataFrame:
    """question_id, rank, id, chapter_index, distance: the k nearest chunks that each question's reader may see.

    questions: question_id, novel_id, at, embedding, embedding_space. chunks: novel_id, chapter_index, id, embedding,
    embedding_space. A question sees chunks of its own novel up to chapter `at`, in its own vector space, where null is a
    space, and of its own length; null novels, chapters or embeddings, empty ones and ones of length zero take no part. The
    gate comes before the ranking. Ties go to the smaller id. Exact: there is no index.
    """
    keys = ["novel_id", "_space", "dim"]
    sound = lambda df: df.where("novel_id is not null and size(embedding) > 0").withColumn("embedding", F.col("embedding").cast("array<double>")).where(F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    told = [F.col("novel_id"), F.coalesce(F.concat(F.lit("="), F.col("embedding_space").cast("string")), F.lit("")).alias("_space"), F.size("embedding").alias("dim")]
    asked = sound(questions).where("at is not null").select(*told, F.col("question_id").cast("string").alias("question_id"), F.col("at").cast("int").alias("at"), F.col("embedding").alias("q_embedding"))
    # chunks of novels that nobody asks about, or beyond all readers' chapters, stay where they are
    furthest = asked.groupBy(*keys).agg(F.max("at").alias("_furthest"))
    held = sound(chunks).select(*told, F.col("id").cast("long").alias("id"), F.col("chapter_index").cast("int").alias("chapter_index"), "embedding").join(furthest, keys).where("chapter_index <= _furthest").drop("_furthest")
    many_q, many_c = large_keys(asked, keys, F.lit(1), question_block, "_qs"), large_keys(held, keys, F.lit(1), chunk_block, "_cs")
    left = repeated(dealt(held, keys, many_c, "_cs", "_c"), keys, many_q, "_qs", "_q")
    right = repeated(dealt(asked, keys, many_q, "_qs", "_q"), keys, many_c, "_cs", "_c")

    def call(a: pa.Table, b: pa.Table) -> pa.Table:
        return _tile(a, b, k)

    by = [*keys, "_c", "_q"]
    right = right.select(*(F.col(c).alias(f"{c}_") if c in by else F.col(c) for c in right.columns))  # both may come from one table
    found = left.groupBy(*by).cogroup(right.groupBy(*(f"{c}_" for c in by))).applyInArrow(call, "question_id string, id long, chapter_index int, distance double")
    order = W.partitionBy("question_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("question_id", "rank", "id", "chapter_index", "distance")


def ask(questions: DataFrame, chunks: DataFrame, k: int = 8, max_chars: int = 48_000) -> DataFrame:
    """question_id, context, sources (id, chapter of each chunk in it) and answer: the fixed one if there is no context, else
    null, which a model is to fill in.

    questions and chunks as for nearest_for_all; chunks have text, and ids of their own in a novel. The nearest chunks come
    first; one that would go over max_chars is skipped, and later ones may still fit.
    """
    found = nearest_for_all(questions, chunks, k).join(questions.select(F.col("question_id").cast("string").alias("question_id"), "novel_id").distinct(), "question_id")
    texts = chunks.select("novel_id", F.col("id").cast("long").alias("id"), "text").dropDuplicates(["novel_id", "id"])
    part = F.concat(F.lit("[chunk:"), F.col("id"), F.lit(" ch:"), F.col("chapter_index"), F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    items = found.join(texts, ["novel_id", "id"]).withColumn("_part", part).select("question_id", "rank", F.length("_part").alias("size"), F.struct("id", "chapter_index", F.col("_part").alias("part")).alias("item"))
    packed = greedy_pack(items, ["question_id"], ["rank"], "size", max_chars)
    every = questions.select(F.col("question_id").cast("string").alias("question_id")).join(packed, "question_id", "left")
    taken = F.coalesce("taken", F.array().cast("array<struct<id: bigint, chapter_index: int, part: string>>"))
    every = every.select("question_id", taken.alias("taken"))
    return every.select(
        "question_id", F.array_join(F.transform("taken", lambda x: x["part"]), "\n").alias("context"), F.transform("taken", lambda x: F.struct(x["id"].alias("id"), x["chapter_index"].alias("chapter"))).alias("sources"), F.when(F.size("taken") == 0, INSUFFICIENT).alias("answer"),
    )
