"""Dealing the rows of large keys over several tasks."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is split so finely only that no more keys than this are split at all: the table of them can be broadcast.
MOST = 1_000_000


def large_keys(rows: DataFrame, keys: Sequence[str], weight: Column, part: int, name: str, least: DataFrame | None = None) -> DataFrame:
    """keys and `name`, into how many parts to deal a key: those whose rows weigh over `part`, or over the MOSTth of all.

    At most MOST rows, marked for broadcast; keys that are not in it are one part. Keys are compared as they are, without nulls.
    least: keys and `_least`, what a part of a key is to weigh at least, if that is more.
    """
    sizes = rows.groupBy(*keys).agg(F.sum(weight).cast("double").alias("_size"))
    each = F.greatest(F.lit(float(part)), sizes.agg(F.sum("_size")).scalar() / MOST)
    if least is not None:
        sizes, each = sizes.join(least, list(keys), "left"), F.greatest(each, "_least")
    return F.broadcast(sizes.withColumn(name, F.ceil(F.col("_size") / each).cast("int")).where(F.col(name) > 1).select(*keys, name))


def dealt(rows: DataFrame, keys: Sequence[str], large: DataFrame, name: str, into: str) -> DataFrame:
    """rows with `into`, the part of its key that each goes to, by a hash of the whole row."""
    plain = [f.name for f in rows.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    part = F.when(F.col(name) > 1, F.pmod(F.xxhash64(*plain), F.col(name))).otherwise(0)
    return rows.join(large, list(keys), "left").withColumn(into, part.cast("int")).drop(name)


def repeated(rows: DataFrame, keys: Sequence[str], large: DataFrame, name: str, into: str) -> DataFrame:
    """Each row once for every part of its key, with the part's number in `into`."""
    return rows.join(large, list(keys), "left").withColumn(into, F.explode(F.sequence(F.lit(0), F.coalesce(name, F.lit(1)) - 1))).drop(name)
