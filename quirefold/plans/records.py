"""Further queries of the catalog: orders, unions, changes of records, claims and labels, each with its SQL."""

from pyspark.sql import functions as F

from quirefold.functions import keys
from quirefold.operators import ledger, mutations
from quirefold.plans.domain import chapters, facts, table, with_
from quirefold.plans.registry import query
from quirefold.streaming import claims

NOW = "1996-01-01"


@query("SELECT c_custkey, max(o_orderkey % 100) AS progress, coalesce(sum(CASE WHEN o_orderstatus IN ('O', 'P') THEN 1 END), 0) AS cancelled, 'new' AS owner FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a17_transfer(spark, d):
    """One progress row a novel, jobs in flight cancelled, the owner rewritten."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 100).alias("progress"), F.col("o_orderstatus").isin("O", "P").cast("long").alias("open"))
    both = table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey")
    return both.groupBy("c_custkey").agg(F.max("progress").alias("progress"), F.sum("open").alias("cancelled")).withColumn("owner", F.lit("new"))


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def a18_missing_objects(spark, d):
    there = table(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(there, "l_partkey", "left_anti").select("l_orderkey", "l_partkey")


_PROVIDERS = "CASE c_custkey % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'disabled' WHEN 2 THEN 'openrouter' WHEN 3 THEN 'ollama' WHEN 4 THEN 'server' END"
_SERVER = {"provider": "ollama", "model": "models/base", "endpoints": {"ollama": "http://localhost:11434/"}}
_ID = lambda provider, model, endpoint: f"""sha256('["{provider}", "' || {model} || '", 64, "{endpoint}"]')"""


@query(f"""WITH c AS (SELECT *, {_PROVIDERS} AS p, c_nationkey % 2 = 0 AS hosted FROM customer), k AS (SELECT *, CASE WHEN hosted AND coalesce(p, 'auto') IN ('auto', 'server') THEN 'auto' ELSE coalesce(p, 'server') END AS kind FROM c)
SELECT c_custkey, CASE kind WHEN 'auto' THEN CASE WHEN c_acctbal > 0 THEN {_ID("gemini", "'embed-1'", "https://generativelanguage.googleapis.com/v1beta")} END WHEN 'openrouter' THEN CASE WHEN c_acctbal > 0 THEN {_ID("openrouter", "c_mktsegment", "https://openrouter.ai/api/v1")} END
WHEN 'ollama' THEN {_ID("ollama", "c_mktsegment", "http://localhost:11434")} WHEN 'server' THEN {_ID("ollama", "'base'", "http://localhost:11434")} END AS space FROM k""")
def b34_embedding_space(spark, d):
    space = keys.bound_space(F.expr(_PROVIDERS), F.col("c_mktsegment"), F.col("c_nationkey") % 2 == 0, F.col("c_acctbal") > 0, _SERVER, 64, "embed-1")
    return table(spark, d, "customer").select("c_custkey", space.alias("space"))


@query(f"SELECT o_orderkey, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'BUILDING' WHERE o_orderdate > TIMESTAMP '{NOW}' AND o_orderstatus = 'O'")
def b35_valid_grants(spark, d):
    active = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey")
    live = table(spark, d, "orders").where((F.col("o_orderdate") > F.lit(NOW).cast("timestamp")) & (F.col("o_orderstatus") == "O"))
    return live.join(active, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_custkey")


@query(with_("chapters") + "SELECT n AS chapter_index, CASE WHEN n <= 12 AND doc_id IS NOT NULL THEN doc_id END AS doc_id, n <= 12 AND doc_id IS NOT NULL AS found FROM (SELECT CAST(unnest(range(1, 41)) AS INT) AS n) LEFT JOIN chapters ON novel_id = 'src3' AND chapter_index = n")
def b36_gated_lookup(spark, d):
    """A chapter above the reader's progress is not found, as if it were missing."""
    asked = spark.range(1, 41).select(F.col("id").cast("int").alias("chapter_index"))
    readable = chapters(spark, d).where("novel_id = 'src3' and chapter_index <= 12").select("chapter_index", "doc_id")
    return asked.join(readable, "chapter_index", "left").select("chapter_index", "doc_id", F.col("doc_id").isNotNull().alias("found"))


_SAMPLES = "SELECT event_id, value / 10 AS seconds, event_id % 23 AS ticks, event_id % 7 AS active FROM events"


@query(f"SELECT event_id, ticks >= greatest(1.0, seconds * 1.6 - 1) AS valid, CASE WHEN ticks > 0 THEN active / ticks END AS overlap FROM ({_SAMPLES})")
def e18_observed_ticks(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("value") / 10).alias("seconds"), (F.col("event_id") % 23).alias("ticks"), (F.col("event_id") % 7).alias("active"))
    return rows.select("event_id", ledger.observed(F.col("seconds"), F.col("ticks")).alias("valid"), F.when(F.col("ticks") > 0, F.col("active") / F.col("ticks")).alias("overlap"))


@query(with_("facts") + "SELECT subject, count(*) AS n FROM (SELECT unnest(subjects) AS subject FROM facts) GROUP BY 1 ORDER BY n DESC, subject")
def f04_by_count(spark, d):
    return facts(spark, d).select(F.explode("subjects").alias("subject")).groupBy("subject").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject")


@query(with_("facts") + "SELECT novel_id, chapter_index, ordinal, conv_id FROM facts WHERE novel_id = 'n3' ORDER BY chapter_index, ordinal, conv_id")
def f05_by_chapter(spark, d):
    return facts(spark, d).where("novel_id = 'n3'").select("novel_id", "chapter_index", "ordinal", "conv_id").orderBy("chapter_index", "ordinal", "conv_id")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def f06_newest_first(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey <> 7, n_name, n_nationkey")
def f08_focused_first(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name").orderBy(F.col("n_nationkey") != 7, "n_name", "n_nationkey")


_NAMES = "string_split(text, ' ')"


@query(f"WITH u AS (SELECT doc_id, unnest({_NAMES}) AS name, unnest(range(0, len({_NAMES}))) AS i FROM documents), f AS (SELECT doc_id, name, min(i) AS i FROM u GROUP BY ALL) SELECT doc_id, string_agg(name, ' ' ORDER BY length(name) DESC, i) AS names FROM f GROUP BY 1")
def f10_longest_first(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(ledger.longest_first(F.split("text", " ")), " ").alias("names"))


@query(f"WITH u AS (SELECT doc_id, unnest({_NAMES}) AS name, unnest(range(0, len({_NAMES}))) AS i FROM documents), f AS (SELECT doc_id, name, min(i) AS i FROM u GROUP BY ALL) SELECT doc_id, string_agg(name, ' ' ORDER BY i) AS names FROM f GROUP BY 1")
def g04_ordered_distinct(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("names"))


@query("SELECT 'review' AS track, o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'glossary', p_partkey FROM part WHERE p_size > 40 UNION ALL SELECT 'wait', s_suppkey FROM supplier")
def g01_g02_tracks(spark, d):
    tracks = [("review", "orders", "o_orderstatus = 'P'", "o_orderkey"), ("glossary", "part", "p_size > 40", "p_partkey"), ("wait", "supplier", "true", "s_suppkey")]
    parts = [table(spark, d, t).where(w).select(F.lit(name).alias("track"), F.col(i).alias("id")) for name, t, w, i in tracks]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT DISTINCT lang, source FROM documents")
def g03_distinct(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


@query("SELECT p_type, arg_min(p_partkey, (p_size <= 20, p_partkey)) AS p_partkey FROM part GROUP BY 1")
def g06_first_spelling(spark, d):
    terms = table(spark, d, "part").select("p_type", "p_partkey", (F.col("p_size") > 20).alias("locked"))
    return ledger.first_spelling(terms, "p_type", "locked", "p_partkey").select("p_type", "p_partkey")


@query("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 30) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_retailprice > 1500)")
def h03_insert_proven(spark, d):
    wanted, parts = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct(), table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey")
    shown, old = wanted.join(parts.where("p_size > 30"), "l_partkey", "left_semi"), wanted.join(parts.where("p_retailprice > 1500"), "l_partkey", "left_semi")
    return ledger.insert_proven(old, wanted, shown, ["l_orderkey", "l_partkey"]).select("l_orderkey", "l_partkey")


@query("SELECT p_partkey, CASE WHEN p_size IS NULL OR p_size > 40 OR p_partkey % 5 = 0 THEN 'inserted' WHEN p_partkey % 3 = 0 THEN 'noop' ELSE 'conflict' END AS outcome FROM part")
def h04_upsert_outcome(spark, d):
    part = table(spark, d, "part")
    old = part.where("p_partkey % 5 != 0").select("p_partkey", F.col("p_type").alias("target"), (F.col("p_size") > 40).alias("deleted"))
    wanted = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise("other").alias("target"))
    return ledger.upsert_outcome(old, wanted, ["p_partkey"]).select("p_partkey", "outcome")


@query("SELECT doc_id, CASE WHEN list_contains([source, lang], CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'xx' END) THEN 'offered' ELSE 'override' END AS origin FROM documents")
def h07_selection_source(spark, d):
    chosen = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("xx")
    return table(spark, d, "documents").select("doc_id", ledger.selection_source(F.array("source", "lang"), chosen).alias("origin"))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 50 ORDER BY o_custkey, o_orderkey")
def h08_claimed_rows(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F' and o_custkey < 50").select("o_custkey", "o_orderkey").orderBy("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, l_linenumber, 'old' AS made FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, 'new' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 3 = 0 AND l_quantity > 25")
def h09_replace_derived(spark, d):
    lines, orders = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), table(spark, d, "orders")
    lines = lines.join(orders, "o_orderkey", "left_semi")
    old, new = lines.select("o_orderkey", "l_linenumber", F.lit("old").alias("made")), lines.where("l_quantity > 25").select("o_orderkey", "l_linenumber", F.lit("new").alias("made"))
    return ledger.replace_partitions(old, new, orders.where("o_orderkey % 3 = 0").select("o_orderkey"), ["o_orderkey"])


@query("WITH v AS (SELECT l_orderkey, max(l_linenumber) AS last FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1) SELECT l_orderkey, l_linenumber, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INT) AS version FROM lineitem LEFT JOIN v USING (l_orderkey) WHERE l_linenumber > 1")
def h10_h11_append_versions(spark, d):
    lines = table(spark, d, "lineitem")
    old = lines.where("l_linenumber <= 2").select("l_orderkey", F.col("l_linenumber").alias("version"))
    return ledger.append_versions(old, lines.where("l_linenumber > 1").select("l_orderkey", "l_linenumber"), ["l_orderkey"], F.col("l_linenumber"))


@query("SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linestatus = a.l_linestatus AND b.l_returnflag = 'R')")
def h12_j04_open_jobs(spark, d):
    keys, lines = ["l_orderkey", "l_linestatus"], table(spark, d, "lineitem")
    return ledger.open_jobs(lines.select(*keys), lines.where("l_returnflag = 'R'").select(*keys), keys)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 THEN 0 ELSE o_custkey % 5 END AS attempts FROM orders")
def h13_h14_resume(spark, d):
    """Resuming clears the attempts, but only where facts are still missing."""
    reset = (F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 2 == 0)
    return table(spark, d, "orders").select("o_orderkey", F.when(reset, F.lit(0).cast("long")).otherwise(F.col("o_custkey") % 5).alias("attempts"))


@query("SELECT c_custkey, c_nationkey + count(o_orderkey) AS fetched FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey")
def h17_h19_counters(spark, d):
    parents = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("fetched"))
    return ledger.counted(parents, table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "fetched")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 4 <> 1 UNION ALL SELECT n_nationkey, 'put' FROM nation WHERE n_nationkey % 4 = 1")
def h18_put(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    return mutations.put(nation, nation.where("n_nationkey % 4 = 1").withColumn("n_name", F.lit("put")), ["n_nationkey"])


_QUEUE = "SELECT o_orderkey AS pos, o_custkey % 9 AS account_id, o_custkey % 40 AS novel_id, o_orderkey % 100 AS chapter_index, o_orderpriority LIKE '1%' AS priority, o_orderstatus = 'F' AS enrichment FROM orders"


def _queue(spark, d):
    return spark.sql(_QUEUE.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


@query(
    f"WITH q AS (SELECT *, CASE account_id % 4 WHEN 0 THEN 'paused' WHEN 1 THEN 'focused' ELSE 'all' END AS mode, 7 AS focus FROM ({_QUEUE}) WHERE account_id <> 2), "
    "r AS (SELECT *, 4 * CAST(novel_id = focus AS INT) + 2 * CAST(priority AS INT) + CAST(NOT enrichment AS INT) AS rank FROM q WHERE mode <> 'paused' AND (mode <> 'focused' OR novel_id = focus)), "
    "a AS (SELECT account_id FROM r GROUP BY 1 ORDER BY CASE WHEN account_id < 6 THEN account_id % 3 ELSE 0 END, min(pos) LIMIT 1), "
    "o AS (SELECT r.* FROM r JOIN a USING (account_id)), b AS (SELECT rank, novel_id FROM o ORDER BY rank DESC, pos LIMIT 1) SELECT account_id, novel_id, chapter_index, pos FROM o JOIN b USING (rank, novel_id) ORDER BY chapter_index, pos LIMIT 1"
)
def j02_fair_claim(spark, d):
    accounts = spark.range(9).select(F.col("id").alias("account_id"), F.when(F.col("id") % 4 == 0, "paused").when(F.col("id") % 4 == 1, "focused").otherwise("all").alias("mode"), F.lit(7).alias("focus"))
    served = spark.range(6).select(F.col("id").alias("account_id"), (F.col("id") % 3).alias("last_seq"))
    return claims.fair_claim(_queue(spark, d), served, spark.range(2, 3).select(F.col("id").alias("account_id")), accounts)


@query("SELECT min(o_orderkey) AS job_id, o_custkey % 9 AS account_id FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 9 <> 4 GROUP BY 2 ORDER BY account_id % 4, job_id LIMIT 2")
def j03_capped_claims(spark, d):
    jobs = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 9).alias("account_id"))
    running = spark.range(4, 5).select(F.col("id").alias("account_id"))
    return claims.capped_claims(jobs, running, spark.range(9).select(F.col("id").alias("account_id"), (F.col("id") % 4).alias("last_seq")))


@query(f"WITH q AS ({_QUEUE}), w AS (SELECT DISTINCT novel_id, chapter_index FROM q WHERE novel_id = 7 AND chapter_index <> 3) SELECT pos, novel_id, chapter_index, priority FROM q ANTI JOIN w USING (novel_id, chapter_index) UNION ALL SELECT (SELECT min(pos) - 1 FROM q), novel_id, chapter_index, true FROM w")
def j05_prioritised(spark, d):
    q = _queue(spark, d)
    busy = q.where("chapter_index = 3").select("novel_id", "chapter_index").distinct()
    return claims.prioritised(q, q.where("novel_id = 7"), busy)


@query("SELECT o_custkey, o_orderkey, o_orderstatus = 'P' AS enrich FROM orders WHERE o_orderstatus IN ('O', 'P')")
def j08_released(spark, d):
    outcome = F.when(F.col("o_orderstatus") == "O", "retry").when(F.col("o_orderstatus") == "P", "enrich").otherwise("done")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("novel_id"), F.col("o_orderkey").alias("chapter_index"), outcome.alias("outcome"), F.lit(True).alias("priority"), F.lit(False).alias("enrichment"))
    return claims.released(rows).select(F.col("novel_id").alias("o_custkey"), F.col("chapter_index").alias("o_orderkey"), F.col("enrichment").alias("enrich"))


@query("SELECT user_id, max(epoch(ts)) > epoch(TIMESTAMP '2024-01-29') AS live FROM events GROUP BY 1")
def j06_j19_liveness(spark, d):
    last = F.unix_timestamp(F.max("ts")) > F.unix_timestamp(F.lit("2024-01-29").cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg(last.alias("live"))


@query("SELECT c_custkey, c_nationkey >= 10 OR coalesce(c_acctbal >= CASE WHEN c_custkey % 2 = 0 THEN 5000 END, false) AS paused FROM customer")
def j14_paused(spark, d):
    limit = F.when(F.col("c_custkey") % 2 == 0, F.lit(5000))
    return table(spark, d, "customer").select("c_custkey", claims.paused(F.col("c_nationkey"), F.lit(10), F.col("c_acctbal"), limit).alias("paused"))


@query(with_("chapters") + "SELECT DISTINCT novel_id, chapter_index FROM chapters, (SELECT unnest([3, 5, 20]) AS n) WHERE chapter_index BETWEEN n + 1 AND n + 4 AND doc_id % 3 <> 0 AND chapter_index <> 7")
def j15_j18_demand(spark, d):
    all_ = chapters(spark, d).withColumn("status", F.when(F.col("doc_id") % 3 == 0, "done").otherwise("ingested"))
    readers = all_.select("novel_id").distinct().select("novel_id", F.explode(F.array(F.lit(3), F.lit(5), F.lit(20))).alias("current_chapter"))
    return claims.demand(readers, all_, all_.where("chapter_index = 7").select("novel_id", "chapter_index"), 4)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Ready to read' WHEN 'P' THEN 'Needs attention' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'Preparing' WHEN o_custkey % 3 = 0 THEN 'Waiting' ELSE 'Not started' END END AS label FROM orders")
def l07_chapter_label(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "error").when(F.col("o_custkey") % 3 == 0, "queued").otherwise("ingested")
    rows = table(spark, d, "orders").select("o_orderkey", status.alias("status"), (F.col("o_custkey") % 2 == 0).alias("active"))
    s = F.col("status")
    label = F.when(s == "done", "Ready to read").when(s == "error", "Needs attention").when(F.col("active"), "Preparing").when(s == "queued", "Waiting").when(s == "ingested", "Not started").otherwise("Checking")
    return rows.select("o_orderkey", label.alias("label"))
