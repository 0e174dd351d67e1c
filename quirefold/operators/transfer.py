"""Exports of a library in versions, and sweeps of what deleted accounts leave behind."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1
_MANIFEST = "format int, version string, name string, kind string, n bigint, hash string"


def _hash(row: Column) -> list[Column]:
    """How many rows, and a hash of them as a set with repeats: sums of two hashes of each, whatever their order."""
    sums = [F.coalesce(F.sum(F.xxhash64(row, F.lit(k)).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in (1, 2)]
    return [F.count("*").alias("n"), F.sha2(F.concat_ws(":", *sums), 256).alias("hash")]


def manifest(tables: dict[str, DataFrame], version: str) -> DataFrame:
    """One row a table: its name, schema, number of rows and hash."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")).agg(*_hash(F.col("row")))
        row = row.select(F.lit(FORMAT).alias("format"), F.lit(version).alias("version"), F.lit(name).alias("name"), F.lit(df.schema.json()).alias("kind"), "n", "hash")
        out = row if out is None else out.unionByName(row)
    return out


def export(tables: dict[str, DataFrame], base: str, version: str) -> None:
    """Writes all tables as JSON lines under base/version, then their manifest, without which a version does not count.

    The manifest is taken from what was written. A version that is whole already is refused.
    """
    spark = next(iter(tables.values())).sparkSession
    if version in {r.version for r in versions(spark, base).collect()}:
        raise ValueError(f"version {version} is there already")
    for name, df in tables.items():
        df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").option("compression", "gzip").text(f"{base}/{version}/tables/{name}")
    written = {name: _table(spark, base, version, name, df.schema.json()) for name, df in tables.items()}
    manifest(written, version).coalesce(1).write.mode("overwrite").json(f"{base}/{version}/manifest")


def _table(spark: SparkSession, base: str, version: str, name: str, kind: str) -> DataFrame:
    from json import loads

    from pyspark.sql.types import StructType

    lines = spark.read.text(f"{base}/{version}/tables/{name}")
    return lines.select(F.from_json("value", StructType.fromJson(loads(kind)), {"mode": "FAILFAST"}).alias("r")).select("r.*")


def versions(spark: SparkSession, base: str) -> DataFrame:
    """The versions that are whole: version and its number of tables. Those without a manifest are left out."""
    try:
        found = spark.read.schema(_MANIFEST).json(f"{base}/*/manifest")
    except Exception as error:  # no version yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = spark.createDataFrame([], _MANIFEST)
    return found.groupBy("version").agg(F.count("*").alias("n_tables"))


def load(spark: SparkSession, base: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version, of the last whole one by name if none is given; ValueError where they are not what the
    manifest says."""
    whole = sorted(r.version for r in versions(spark, base).collect())
    version = version or (whole[-1] if whole else None)
    if version not in whole:
        raise ValueError(f"no whole export {version or ''} in {base}")
    said = {r.name: r for r in spark.read.schema(_MANIFEST).json(f"{base}/{version}/manifest").collect()}  # a row a table
    if any(r.format != FORMAT for r in said.values()):
        raise ValueError("an export of another format")
    tables = {name: _table(spark, base, version, name, r.kind) for name, r in said.items()}
    for r in manifest(tables, version).collect():
        if (r.n, r.hash) != (said[r.name].n, said[r.name].hash):
            raise ValueError(f"table {r.name} of export {version} is not what was written")
    return tables


def outbox(deleted: DataFrame, novels: DataFrame, now: Column) -> DataFrame:
    """What a deletion of accounts leaves to do: a row for each novel (id, owner_id) of a deleted account (account_id)."""
    owned = novels.select(F.col("id").alias("novel_id"), F.col("owner_id").alias("account_id"))
    return owned.join(deleted.select("account_id").distinct(), "account_id", "left_semi").select("account_id", "novel_id", F.lit(0).alias("attempts"), now.alias("retry_at"), F.lit(None).cast("timestamp").alias("completed_at"))


def due(work: DataFrame, now: Column, most: int | None = 50) -> DataFrame:
    """The oldest open rows of an outbox whose time has come, `most` at a time."""
    rows = work.where(F.col("completed_at").isNull() & (F.col("retry_at") <= now)).orderBy("retry_at", "account_id", "novel_id")
    return rows.limit(most) if most else rows


def swept(tables: dict[str, DataFrame], work: DataFrame, done: DataFrame, now: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """tables without the rows of the novels in `done`, and the outbox after that: each row is swept twice, an hour
    apart, since writers may have been at work the first time; then it is complete. Sweeping again changes nothing."""
    gone = done.select("novel_id")
    key = lambda name: "id" if name == "novel" else "novel_id"
    kept = {name: df.join(gone.select(F.col("novel_id").alias(key(name))).distinct(), key(name), "left_anti") for name, df in tables.items()}
    told = work.join(done.select("account_id", "novel_id", F.lit(True).alias("_done")), ["account_id", "novel_id"], "left")
    hit = F.coalesce("_done", F.lit(False))
    later = told.select(
        "account_id", "novel_id", F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"), F.when(hit, now + F.expr("interval 1 hour")).otherwise(F.col("retry_at")).alias("retry_at"), F.when(hit & (F.col("attempts") >= 1), now).otherwise(F.col("completed_at")).alias("completed_at"),
    )
    return kept, later


def removable(accounts: DataFrame, novels: DataFrame, work: DataFrame) -> DataFrame:
    """Accounts (id, status) being deleted that own no novel and have no open work."""
    open_ = work.where("completed_at IS NULL").select(F.col("account_id").alias("id"))
    return accounts.where("status = 'deleting'").join(novels.select(F.col("owner_id").alias("id")), "id", "left_anti").join(open_, "id", "left_anti")
