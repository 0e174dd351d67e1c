"""Exact gated vector search."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.gate import gate


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def gated_top_k(chunks: DataFrame, question: list[float], novel: str | None, at: int | None, space: str, k: int = 8) -> DataFrame:
    """The k nearest chunks of one novel up to a chapter, in one vector space; ties go to the smaller id.

    The gate comes before the ranking, so nothing beyond it can push a visible chunk out. Null vectors take no part.
    """
    seen = gate(chunks, novel, at).filter(F.col("embedding").isNotNull() & F.col("embedding_space").eqNullSafe(space))
    asked = F.array(*(F.lit(float(x)) for x in question))
    return seen.withColumn("distance", cosine_distance(F.col("embedding"), asked)).orderBy("distance", "id").limit(k)
