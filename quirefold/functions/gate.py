"""Chapter gates: a reader sees rows up to a chapter of one novel, and nothing where either is unset."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def gate(df: DataFrame, novel: str | None = None, at: int | None = None, chapter: str = "chapter_index") -> DataFrame:
    """Rows of a novel up to chapter `at`; with the defaults, none. A plain filter, so it reaches the scan."""
    return df.filter((F.col("novel_id") == F.lit(novel)) & (F.col(chapter) <= F.lit(-1 if at is None else at)))


def as_of(df: DataFrame, at: int, learned: str = "source_chapter", start: str = "valid_from", end: str | None = "valid_to") -> DataFrame:
    """Two clocks: what is known at `at` and holds at `at`; end is exclusive and may be null."""
    known = df.filter((F.col(learned) <= at) & (F.col(start) <= at))
    return known if end is None else known.filter(F.col(end).isNull() | (F.col(end) > at))


def effective_chapter(requested: Column, progress: Column) -> Column:
    """The smaller of the requested and the stored chapter; null (not found) without progress."""
    return F.when(progress.isNotNull(), F.least(F.coalesce(requested, progress), progress))  # least() skips nulls


def lenient_chapter(requested: Column, progress: Column) -> Column:
    """Like effective_chapter, with no progress counted as chapter 0."""
    stored = F.coalesce(progress, F.lit(0))
    return F.least(stored, F.coalesce(requested, stored))


def owned(df: DataFrame, novels: DataFrame, account: str | None) -> DataFrame:
    """Only rows of novels that the account owns; none for no account."""
    return df.join(novels.filter(F.col("owner_id") == F.lit(account)).select(F.col("id").alias("novel_id")), "novel_id", "left_semi")


def register_views(spark: SparkSession, tables: dict[str, DataFrame], novel: str | None = None, at: int | None = None) -> None:
    """Registers each table as a temp view behind the gate, so that SQL over the views can't read past it."""
    for name, df in tables.items():
        gate(df, novel, at).createOrReplaceTempView(name)
