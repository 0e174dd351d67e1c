"""Expiry over streams, queue logs, previews, exports, sweeps and row policies."""

import random

import pytest
from pyspark.sql import functions as F

from quirefold.functions import policies
from quirefold.operators import transfer
from quirefold.sources import queue_log
from quirefold.streaming import ordered

LOG = "key string, ts timestamp, event_id long, action string, value string, requested string, served string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def calls(n=160, seed=3):
    """Calls over an hour, and one of another key much later, by which all are passed."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        put = r.random() < 0.4
        out.append((r.choice("abc"), 1_700_000_000 + r.randrange(0, 3600, 5), i, "put" if put else "get", f"v{i}" if put else None, "m" if put else None, r.choice(["m", "m", "other"]) if put else None))
    return out


def written(spark, rows, path, schema=LOG):
    names = schema.replace(",", "").split()[::2]
    df = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts")).select(*names)
    df.coalesce(1).write.mode("append").parquet(path)


def ran(stream, checkpoint, out):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination(240)


def test_cache_over_a_stream_is_a_replay(rocks, tmp_path):
    """Rows out of order and over batches, with a restart between them: the outcome of a replay of the whole log."""
    spark, rows = rocks, calls()
    r = random.Random(1)
    mixed = sorted(rows, key=lambda x: x[1] + r.randrange(0, 500))  # up to 500 s out of order
    end = [("z", 1_700_000_000 + 10**6, 10**6, "get", None, None, None), ("z", 1_700_000_000 + 2 * 10**6, 10**6 + 1, "get", None, None, None)]
    src, out, at = (str(tmp_path / x) for x in ("src", "out", "at"))
    late = ("a", 1_700_000_000 - 10**5, 5000, "put", "late", "m", "m")
    for part in (mixed[:60], mixed[60:120], [*mixed[120:], end[0]], [late, end[1]]):
        written(spark, part, src)
        ran(ordered.cache_stream(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src), 300.0), at, out)  # a new query each: a restart
    got = {x.event_id: (x.outcome, x.value) for x in spark.read.parquet(out).collect()}
    log = spark.createDataFrame([(k, float(t), *rest) for k, t, *rest in rows], "key string, ts double, event_id long, action string, value string, requested string, served string")
    want = {x.event_id: x.outcome for x in ordered.cache_replay(log, 300.0).collect()}
    assert {k: v[0] for k, v in got.items() if k < 1000} == want and 5000 not in got
    assert {"stored", "refused", "hit", "miss"} == set(want.values())
    held = {}
    for k, t, i, action, value, requested, served in sorted(rows, key=lambda x: (x[1], x[2])):
        if action == "put" and requested == served:
            held[k] = (value, t)
        elif action == "get":
            ok = k in held and t < held[k][1] + 300
            assert got[i] == (("hit", held[k][0]) if ok else ("miss", None))


def test_liveness_over_a_stream_is_a_replay(rocks, tmp_path):
    spark, r = rocks, random.Random(2)
    beats = [(r.choice("abc"), 1_700_000_000 + t) for t in range(0, 1200, 7) if r.random() < 0.4]
    src, out, at = (str(tmp_path / x) for x in ("src", "out", "at"))
    mixed = sorted(beats, key=lambda x: x[1] + r.randrange(0, 50))
    for part in (mixed[:30], [*mixed[30:], ("z", 1_700_000_000 + 10**6)], [("z", 1_700_000_000 + 10**6 + 200)]):
        written(spark, part, src, "key string, ts timestamp")
        ran(ordered.liveness_stream(spark.readStream.schema("key string, ts timestamp").parquet(src)), at, out)
    got = sorted((x.key, x.at, x.state) for x in spark.read.parquet(out).where("key <> 'z'").collect())
    whole = spark.createDataFrame([*beats, *((k, 1_800_000_000) for k in "abc")], "key string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    want = sorted((x.key, x.at, x.state) for x in ordered.liveness_replay(whole).where("at < 1790000000000").collect())
    assert got == want and {x[2] for x in got} == {"alive", "gone"}


def test_queue_log_counts_a_batch_once(spark, tmp_path):
    base = str(tmp_path / "q")
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "v int")
    queue_log.push(rows(1, 2), base, 0)
    rows(3, 4).write.parquet(f"{base}/rows/batch=1")  # cut off before its marker
    assert sorted(x.v for x in queue_log.read(spark, base).collect()) == [1, 2]
    queue_log.push(rows(3, 5), base, 1)
    queue_log.push(rows(3, 5), base, 1)  # tried again
    assert sorted(x.v for x in queue_log.read(spark, base).collect()) == [1, 2, 3, 5]
    seen, fails = [], [True]

    def work(df, batch):
        found = sorted(x.v for x in df.collect())
        if fails[0] and batch == 1:
            fails[0] = False
            raise RuntimeError("killed")
        seen.append((batch, found))

    checkpoint = str(tmp_path / "c")
    queue_log.consume(spark, base, work, checkpoint).awaitTermination(120)
    queue_log.push(rows(7), base, 2)
    with pytest.raises(Exception, match="killed"):
        queue_log.consume(spark, base, work, checkpoint).awaitTermination(120)
    queue_log.consume(spark, base, work, checkpoint).awaitTermination(120)
    queue_log.consume(spark, base, work, checkpoint).awaitTermination(120)
    assert seen == [(0, [1, 2, 3, 5]), (1, [7])]


def test_stream_into_a_queue_log(spark, tmp_path):
    """A sink that fails after writing rows: the retry replaces them."""
    src, base = str(tmp_path / "s"), str(tmp_path / "q")
    spark.createDataFrame([(1,), (2,)], "v int").coalesce(1).write.parquet(src)
    fails = [True]

    def step(df, batch):
        queue_log.sink(base)(df, batch)
        if fails[0]:
            fails[0] = False
            raise RuntimeError("killed")

    run = lambda: spark.readStream.schema("v int").parquet(src).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    assert sorted(x.v for x in queue_log.read(spark, base).collect()) == [1, 2]


def test_queue_operations(spark):
    r, queue, log = random.Random(4), {"a": [], "b": []}, []
    for seq in range(200):
        q, op, v = r.choice("ab"), r.choice(["rpush", "lpush", "rpush", "lrem"]), r.choice("uvwxyz")
        log.append((q, seq, op, v))
        queue[q] = [*queue[q], v] if op == "rpush" else [v, *queue[q]] if op == "lpush" else [x for x in queue[q] if x != v]
    got = {"a": [], "b": []}
    for x in queue_log.listed(spark.createDataFrame(log, "queue string, seq long, op string, value string")).orderBy("queue", "place").collect():
        assert x.place == len(got[x["queue"]])
        got[x["queue"]].append(x.value)
    assert got == queue


def test_previews(spark, tmp_path):
    base, rows = str(tmp_path / "p"), "key string, ts double, event_id long, text string"
    write = queue_log.preview_sink(base)
    first = spark.createDataFrame([("a", 10.0, 1, "x"), ("a", 10.4, 2, "xy"), ("a", 10.6, 3, "xyz"), ("b", 10.1, 4, "q")], rows)
    write(first, 0)
    write(first, 0)
    write(spark.createDataFrame([("a", 10.9, 5, "same interval"), ("a", 11.2, 6, "xyz!")], rows), 1)
    kept = [(x.key, x.tick, x.text) for x in queue_log.read(spark, base).collect()]
    assert sorted(kept) == [("a", 20, "xy"), ("a", 21, "xyz"), ("a", 22, "xyz!"), ("b", 20, "q")]
    assert {(x.key, x.text) for x in queue_log.previews(spark, base, 910.5).collect()} == {("a", "xyz!")}
    assert queue_log.previews(spark, base, 10**6).count() == 0


def test_exports(spark, tmp_path):
    base = str(tmp_path / "e")
    t = {"novel": spark.createDataFrame([(1, "a", None), (2, "ä\n", [1.5])], "id int, owner_id string, x array<double>"), "chapter": spark.createDataFrame([], "novel_id int, at timestamp")}
    with pytest.raises(ValueError):
        transfer.load(spark, base)
    transfer.export(t, base, "v1")
    t["novel"].selectExpr("to_json(struct(*)) AS value").write.text(f"{base}/v2/tables/novel")  # cut off before its manifest
    assert [r.version for r in transfer.versions(spark, base).collect()] == ["v1"]
    got = transfer.load(spark, base)
    assert {k: (v.schema, sorted(v.collect())) for k, v in got.items()} == {k: (v.schema, sorted(v.collect())) for k, v in t.items()}
    with pytest.raises(ValueError):
        transfer.export(t, base, "v1")
    transfer.export({"novel": t["novel"].limit(1), "chapter": t["chapter"]}, base, "v2")
    assert transfer.load(spark, base)["novel"].count() == 1 and transfer.load(spark, base, "v1")["novel"].count() == 2
    t["novel"].where("id = 1").unionByName(t["novel"].where("id = 1")).selectExpr("to_json(struct(*)) AS value").write.mode("overwrite").text(f"{base}/v1/tables/novel")
    with pytest.raises(ValueError):
        transfer.load(spark, base, "v1")


def test_sweeps(spark):
    at = lambda h: F.lit(f"2024-01-01 {h:02d}:00:00").cast("timestamp")
    novels = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, owner_id string")
    tables = {"novel": novels, "chapter": spark.createDataFrame([(1, 1), (2, 1), (3, 1), (None, 9)], "novel_id int, n int")}
    work = transfer.outbox(spark.createDataFrame([("x",), ("none",)], "account_id string"), novels, at(1))
    assert sorted((r.account_id, r.novel_id, r.attempts) for r in work.collect()) == [("x", 1, 0), ("x", 2, 0)]
    assert transfer.due(work, at(0)).count() == 0
    accounts = spark.createDataFrame([("x", "deleting"), ("y", "active"), ("w", "deleting")], "id string, status string")
    assert {r.id for r in transfer.removable(accounts, novels, work).collect()} == {"w"}
    done = transfer.due(work, at(1))
    kept, work = transfer.swept(tables, work, done, at(1))
    again, _ = transfer.swept(kept, work, done, at(1))
    want = {"novel": [(3, "y")], "chapter": [(3, 1), (None, 9)]}
    for found in (kept, again):
        assert {k: sorted(map(tuple, v.collect()), key=str) for k, v in found.items()} == want
    assert {(r.attempts, r.completed_at) for r in work.collect()} == {(1, None)} and transfer.due(work, at(1)).count() == 0
    _, work = transfer.swept(kept, work, transfer.due(work, at(2)), at(2))
    assert all(r.attempts == 2 and r.completed_at for r in work.collect()) and transfer.due(work, at(9)).count() == 0
    assert {r.id for r in transfer.removable(accounts, kept["novel"], work).collect()} == {"x", "w"}


def test_row_policies_hold_without_a_filter(spark):
    rows = spark.createDataFrame([("n", 1, "a", None), ("n", 5, "a", "held"), ("n", 9, "a", "passed"), ("m", 1, "b", "passed"), (None, 1, None, None)], "novel_id string, chapter_index int, owner_id string, review_state string")
    policies.register(spark, {"p_facts": (rows, ["novel", "chapter", "reviewed"]), "p_owned": (rows, ["account"]), "p_none": (rows, [])})
    seen = lambda name: sorted((r.novel_id or "", r.chapter_index) for r in spark.sql(f"SELECT * FROM {name}").collect())
    assert seen("p_facts") == [] and seen("p_owned") == [] and seen("p_none") == []
    policies.read_as(spark, "n", 5, "b")
    assert seen("p_facts") == [("n", 1)] and seen("p_owned") == [("m", 1)] and seen("p_none") == []
    assert spark.sql("SELECT count(*) AS n FROM p_facts f JOIN p_owned o ON true WHERE f.novel_id <> 'm' OR true").first().n == 1
    policies.read_as(spark, "n", 100)
    assert seen("p_facts") == [("n", 1), ("n", 9)] and seen("p_owned") == []
    policies.read_as(spark, "n")
    assert seen("p_facts") == []
    policies.read_as(spark)
