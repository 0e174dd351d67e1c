"""The registered queries of the engine and the SQL they are checked against."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.functions import gate, states
from quirefold.functions import text as tx
from quirefold.operators import chunks, hashing, mutations, retrieval, scan, statistics, versions
from quirefold.plans import more, reading, records, said, steps, texts  # noqa: F401  registers their queries
from quirefold.plans.domain import AT, NOVEL, chapters, events, facts, retractions, table, with_
from quirefold.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from quirefold.sources import pages as pages_source
from quirefold.streaming import queues

FACT_KEY = ["novel_id", "chapter_index", "prompt_version", "ordinal"]


def current_facts(spark: SparkSession, d: str) -> DataFrame:
    return versions.without(versions.current_version(facts(spark, d), ["novel_id", "chapter_index"], "prompt_version"), retractions(spark, d), FACT_KEY)


GATED = f"novel_id = '{NOVEL}' AND chapter_index <= {AT}"


@query(with_("facts", "retractions", "current") + f"SELECT subject, count(*) AS n_facts FROM (SELECT unnest(subjects) AS subject FROM current WHERE {GATED}) GROUP BY subject")
def wiki_pages(spark, d):
    """Pages a reader may see: facts of each subject, current, not retracted, up to the reader's chapter."""
    seen = gate.gate(current_facts(spark, d), NOVEL, AT)
    return seen.select(F.explode("subjects").alias("subject")).groupBy("subject").agg(F.count("*").alias("n_facts")).orderBy(F.desc("n_facts"), "subject")


@query(with_("chapters") + "SELECT doc_id, chapter_index FROM chapters WHERE novel_id = 'src3' AND chapter_index <= 20")
def b01_chapter_gate(spark, d):
    return gate.gate(chapters(spark, d), "src3", 20).select("doc_id", "chapter_index")


@query(with_("chapters") + "SELECT count(*) AS n FROM chapters WHERE novel_id = NULL AND chapter_index <= -1")
def b02_fails_closed(spark, d):
    return gate.gate(chapters(spark, d)).agg(F.count("*").alias("n"))


def _requests(spark, d):
    p = events(spark, d).where("event_type = 'view' and user_id % 3 != 0").groupBy("user_id").agg(F.max(F.col("event_id") % 40).alias("p"))
    q = events(spark, d).select("user_id", F.when(F.col("user_id") % 4 > 0, F.col("user_id") % 50).alias("r")).distinct()
    return q.join(p, "user_id", "left")


REQUESTS = "WITH p AS (SELECT user_id, max(event_id % 40) AS p FROM events WHERE event_type = 'view' AND user_id % 3 != 0 GROUP BY 1), q AS (SELECT DISTINCT user_id, CASE WHEN user_id % 4 > 0 THEN user_id % 50 END AS r FROM events) "


@query(REQUESTS + "SELECT q.user_id, least(coalesce(r, p), p) AS at FROM q JOIN p USING (user_id)")
def b03_effective_chapter(spark, d):
    return _requests(spark, d).select("user_id", gate.effective_chapter(F.col("r"), F.col("p")).alias("at")).where("at is not null")


@query(REQUESTS + "SELECT q.user_id, least(coalesce(p, 0), coalesce(r, coalesce(p, 0))) AS at FROM q LEFT JOIN p USING (user_id)")
def b04_lenient_chapter(spark, d):
    return _requests(spark, d).select("user_id", gate.lenient_chapter(F.col("r"), F.col("p")).alias("at"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def b06_account_boundary(spark, d):
    novels = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("owner_id"))
    return gate.owned(table(spark, d, "orders").withColumnRenamed("o_custkey", "novel_id"), novels, "7").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 4 AND l_partkey % 10 <= 4 AND (l_suppkey % 9 = 0 OR l_suppkey % 9 > 4)")
def b08_as_of_two_clocks_h(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("source_chapter"), (F.col("l_partkey") % 10).alias("valid_from"), F.when(F.col("l_suppkey") % 9 > 0, F.col("l_suppkey") % 9).alias("valid_to"))
    return gate.as_of(rows, 4).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'error' ELSE 'pending' END AS status FROM orders")
def b09_status_projection(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.when(s == "F", "done").when(s == "P", "error").otherwise("pending").alias("status"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INT), 1) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def b11_json_path(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(1)).alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(split_part(p_brand, '#', 2), '^[0-9]+$') THEN CAST(split_part(p_brand, '#', 2) AS INT) ELSE 1 END AS part FROM part")
def b12_guarded_cast(spark, d):
    x = F.when(F.contains("p_brand", F.lit("#")), F.substring_index("p_brand", "#", -1)).otherwise("")
    return table(spark, d, "part").select("p_partkey", F.when(x.rlike("^[0-9]+$"), x.try_cast("int")).otherwise(1).alias("part"))


@query("SELECT page_id FROM pages WHERE url LIKE '%://m.%'")
def b13_host_like(spark, d):
    return table(spark, d, "pages").where(F.contains("url", F.lit("://m."))).select("page_id")


@query(with_("chapters") + "SELECT doc_id FROM chapters WHERE chapter_index BETWEEN 3 AND 9 AND (lang = 'en' OR n_chars < 500)")
def b14_range_or(spark, d):
    return chapters(spark, d).where(F.col("chapter_index").between(3, 9) & ((F.col("lang") == "en") | (F.col("n_chars") < 500))).select("doc_id")


@query(with_("facts") + "SELECT conv_id, ordinal FROM facts WHERE list_contains(subjects, 's5')")
def b16_array_membership(spark, d):
    return facts(spark, d).where(F.array_contains("subjects", "s5")).select("conv_id", "ordinal")


@query("SELECT vec_id FROM embeddings WHERE nullif(label, 3) IS NOT DISTINCT FROM NULL")
def b17_null_safe_equal(spark, d):
    return table(spark, d, "embeddings").where(F.nullif("label", F.lit(3)).eqNullSafe(F.lit(None))).select("vec_id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 3 AND l_returnflag != 'R' THEN 'locked' WHEN l_partkey % 20 <= 3 THEN 'pending' ELSE 'unlocked' END AS status FROM lineitem")
def b19_rendering_status(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", states.rendering_status(F.col("l_linenumber"), F.col("l_partkey") % 20, F.col("l_returnflag") == "R", 3).alias("status"))


#: Code, what a reader is shown of it, and what may leave the engine, one row for every rule.
CODES = (
    (None, "", "stage_failed"), ("", "", "stage_failed"), ("provider_retry_exhausted", "provider_retry_exhausted", "provider_retry_exhausted"), ("output_limit", "output_limit", "output_limit"), ("model_changed", "unknown", "model_changed"),
    ("provider_http_401", "credential_rejected", "provider_http_401"), ("provider_http_404", "model_not_available", "provider_http_404"), ("provider_http_408", "timeout", "stage_failed"), ("provider_http_429", "rate_limited", "provider_http_429"),
    ("provider_http_499", "unknown", "stage_failed"), ("provider_http_503", "model_server_error", "stage_failed"), ("provider_http_", "unknown", "stage_failed"), ("provider_http_5x", "unknown", "stage_failed"), ("provider_timeout", "timeout", "provider_timeout"),
    ("provider_connection", "unreachable", "provider_connection"), ("quota_exhausted", "unknown", "quota_exhausted"), ("odd", "unknown", "stage_failed"), ("prompt_too_large", "prompt_too_large", "prompt_too_large"),
)
_pick = lambda values, i: f"[{', '.join('NULL' if v is None else f'{v!r}e0' if isinstance(v, float) else repr(v) for v in values)}][event_id % {len(values)} + 1] AS {i}"
_elt = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))


@query(f"SELECT event_id, {_pick([c[1] for c in CODES], 'category')}, {_pick([c[2] for c in CODES], 'safe')} FROM events")
def b23_b24_error_category(spark, d):
    rows = table(spark, d, "events").select("event_id", _elt([c[0] for c in CODES]).alias("code"))
    return rows.select("event_id", states.reader_category(F.col("code")).alias("category"), states.safe_code(F.col("code")).alias("safe"))


#: Category, kind, status, path, body, retry-after and message of an error; its code, its class, the wait it names, and
#: whether it is a quota used up. One row for every kind of rule.
ERRORS = (
    ("request_budget", None, None, None, None, None, None, "prompt_too_large", "unknown", None, False), ("unreachable", None, None, None, None, None, None, "model_unreachable", "model_unreachable", None, False),
    ("embed_unavailable", None, None, None, None, None, None, "embed_unavailable", "embed_unavailable", None, False), (None, "timeout", None, None, None, None, "ReadTimeout: timed out", "provider_timeout", "timeout", None, False),
    (None, "transport", None, None, None, None, "ConnectError: All connection attempts failed", "provider_connection", "model_unreachable", None, False), (None, "status", 413, "/v1/messages", "", None, "", "provider_http_413", "prompt_too_large", None, False),
    (None, "status", 400, "/v1/messages", '{"error": {"code": "json_validate_failed"}}', None, "", "provider_http_400", "provider_invalid_json", None, False), (None, "status", 422, "/x", '{"error": "what"}', None, "", "provider_http_422", "provider_bad_request", None, False),
    (None, "status", 404, "/v1/chat/completions", "", None, "", "provider_http_404", "model_not_available", None, False), (None, "status", 404, "/books/1", "", None, "book not found", "provider_http_404", "not_found", None, False),
    (None, "status", 429, "/v1/messages", "Please retry in 55.5s.", None, "", "provider_http_429", "rate_limited", 55.5, False), (None, "status", 429, "/v1/messages", '"retryDelay": "7200s"', None, "", "provider_http_429", "quota_exhausted", 7200.0, True),
    (None, "status", 429, "/v1/messages", "slow down", "4000", "", "provider_http_429", "quota_exhausted", None, True), (None, "status", 429, "/v1/messages", "DAILY limit", "soon", "", "provider_http_429", "quota_exhausted", None, True),
    (None, "status", 502, "/v1/messages", "", None, "", "provider_http_502", "model_server_error", None, False), (None, "batch", None, None, None, None, "x", "provider_batch_failed", "unknown", None, False),
    (None, "value", None, None, None, None, "x", "invalid_stage_output", "unknown", None, False), (None, None, None, None, None, None, "Ollama exhausted num_predict; refusing incomplete output", "output_truncated", "output_truncated", None, False),
    (None, None, None, None, None, None, "No configured API key", "credential_missing", "credential_missing", None, False), (None, None, None, None, None, None, "provider unreachable: ReadTimeout", "model_unreachable", "model_unreachable", None, False),
    (None, None, None, None, None, None, "what", "stage_failed", "unknown", None, False), (None, None, None, None, None, None, None, "stage_failed", "unknown", None, False),
)


@query("SELECT event_id, " + ", ".join(_pick([e[7 + i] for e in ERRORS], n) for i, n in enumerate(("code", "class", "hint", "used_up"))) + " FROM events")
def b25_b26_error_code(spark, d):
    e = table(spark, d, "events").select("event_id", *(_elt([x[i] for x in ERRORS]).cast("int" if n == "status" else "string").alias(n) for i, n in enumerate(("category", "kind", "status", "path", "body", "retry_after", "message"))))
    own = [F.col(n) for n in ("status", "path", "body", "retry_after", "message")]
    return e.select("event_id", states.error_code(F.col("category"), F.col("kind"), *own).alias("code"), states.failure_category(F.col("category"), *own).alias("class"), states.retry_hint(F.col("body")).alias("hint"), states.quota_exhausted(F.col("body"), F.col("retry_after")).alias("used_up"))


@query("SELECT c_custkey, coalesce(o.n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def c01_left_default(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) o ON c_custkey = o_custkey AND n = 1")
def c02_lateral_top_1(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return versions.with_latest(table(spark, d, "customer"), o, ["c_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("c_custkey", "o_orderkey")


@query("SELECT p_partkey, l_orderkey, l_linenumber FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity <= 3 AND l_returnflag <> 'R'")
def c03_left_residual(spark, d):
    right = table(spark, d, "lineitem").where("l_quantity <= 3 and l_returnflag <> 'R'").withColumnRenamed("l_partkey", "p_partkey")
    return table(spark, d, "part").join(right, "p_partkey", "left").select("p_partkey", "l_orderkey", "l_linenumber")


@query("SELECT DISTINCT p_brand, s_nationkey FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey")
def c04_distinct_join(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return rows.select("p_brand", "s_nationkey").distinct()


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)")
def c05_semi(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey AND s_acctbal < 0)")
def c06_semi_or(spark, d):
    keys = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).unionByName(table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("c_custkey")))
    return table(spark, d, "customer").join(keys, "c_custkey", "left_semi").select("c_custkey")


@query(with_("facts", "retractions") + "SELECT conv_id, ordinal FROM facts f WHERE NOT EXISTS (SELECT 1 FROM retractions r WHERE r.novel_id = f.novel_id AND r.chapter_index = f.chapter_index AND r.prompt_version = f.prompt_version AND r.ordinal = f.ordinal)")
def c07_anti_retraction(spark, d):
    return versions.without(facts(spark, d), retractions(spark, d), FACT_KEY).select("conv_id", "ordinal")


@query("WITH a AS (SELECT event_id, user_id, s, s + 1800 AS e FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) WHERE event_type = 'view'), b AS (SELECT user_id, s, s + 3600 AS e FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) WHERE event_type = 'error') SELECT event_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.user_id = b.user_id AND a.s < b.e AND b.s < a.e)")
def c11_interval_anti(spark, d):
    e = events(spark, d)
    b = e.where("event_type = 'error'").select(F.col("user_id").alias("u"), F.col("s").alias("bs"))
    return e.where("event_type = 'view'").join(b, (F.col("user_id") == F.col("u")) & (F.col("s") < F.col("bs") + 3600) & (F.col("bs") < F.col("s") + 1800), "left_anti").select("event_id")


@query("WITH k AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, p_brand FROM part), u AS (SELECT key, min(p_brand) AS brand FROM k GROUP BY key HAVING count(DISTINCT p_brand) = 1) SELECT p_partkey, brand FROM part LEFT JOIN u ON key = regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')")
def c13_unambiguous_spelling(spark, d):
    keyed = table(spark, d, "part").withColumn("key", tx.normalized_rendering(F.col("p_name")))
    return keyed.join(versions.unambiguous(keyed, "key", "p_brand").withColumnRenamed("p_brand", "brand"), "key", "left").select("p_partkey", "brand")


@query("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def c16_presence(spark, d):
    terms = table(spark, d, "benchmark").select("item_id", F.col("text").alias("term"))
    return scan.presence(table(spark, d, "documents").select("doc_id", "text"), terms).select("doc_id", "item_id")


@query(with_("facts") + "SELECT subject, count(*) AS n FROM (SELECT unnest(subjects) AS subject FROM facts) GROUP BY subject")
def c17_d08_unnest_count(spark, d):
    return facts(spark, d).select(F.explode("subjects").alias("subject")).groupBy("subject").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT event_id AS id, user_id, epoch(ts) AS a, epoch(ts) + 7200 AS b FROM events WHERE event_type = 'signup'), e AS (SELECT user_id, epoch(ts) AS t, value FROM events WHERE event_type = 'purchase') SELECT id, count(t) AS n_matches, CASE WHEN count(t) = 1 THEN max(value) END AS tokens FROM s LEFT JOIN e ON s.user_id = e.user_id AND t BETWEEN a AND b GROUP BY id")
def c21_containment_unique(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    samples = e.where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("t").alias("started"), (F.col("t") + 7200).alias("finished"))
    return statistics.only_match(samples, e.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("t").alias("ts"), F.col("value").alias("tokens")))


_LINKS = "SELECT p_partkey AS id, CASE WHEN p_partkey = 1 THEN 2 WHEN p_partkey = 2 THEN 1 WHEN p_partkey % 4 <> 0 THEN p_partkey {} 3 END AS to_id FROM part"


@query(f"WITH RECURSIVE l AS ({_LINKS.format('//')}), w AS (SELECT id, id AS node, 0 AS depth FROM l UNION ALL SELECT w.id, l.to_id, depth + 1 FROM w JOIN l ON l.id = w.node WHERE l.to_id IS NOT NULL AND depth < 30) SELECT id, CASE WHEN max(depth) < 30 THEN arg_max(node, depth) END AS root, max(depth) >= 30 AS cyclic FROM w GROUP BY 1")
def c25_recursive_chain(spark, d):
    """What each part is superseded by in the end; two supersede each other."""
    return versions.resolved(spark.sql(_LINKS.format("div").replace("FROM part", "FROM {part}"), part=table(spark, d, "part")), 30)


@query(with_("chapters") + "SELECT novel_id, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) AS n_long, coalesce(max(chapter_index), 0) + 1 AS next_index FROM chapters GROUP BY 1")
def d01_d02_d06_counts(spark, d):
    return chapters(spark, d).groupBy("novel_id").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2000).alias("n_long"), (F.coalesce(F.max("chapter_index"), F.lit(0)) + 1).alias("next_index"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_targets FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def d03_unstable_terms(spark, d):
    return versions.unstable_terms(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT user_id, CASE WHEN f >= 70 THEN 'failing' WHEN w > 60 THEN 'warning' WHEN o >= 8 AND u * 4 >= o THEN 'unstable' ELSE 'healthy' END AS health FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS f, count(*) FILTER (WHERE event_type = 'signup') AS w, count(*) AS o, count(*) FILTER (WHERE event_type = 'click') AS u FROM events GROUP BY 1)")
def d05_health(spark, d):
    of = lambda t: F.count_if(F.col("event_type") == t)
    rows = table(spark, d, "events").groupBy("user_id").agg(of("error").alias("f"), of("signup").alias("w"), F.count("*").alias("o"), of("click").alias("u"))
    return rows.select("user_id", states.health(F.floor(F.col("f") / 70) * 3, F.when(F.col("w") > 60, F.col("w")).otherwise(0), F.col("o"), F.col("u")).alias("health"))


@query("SELECT event_type, count(value) AS n, round(median(value), 3) AS median, round(min(value), 3) AS min, round(max(value), 3) AS max FROM events GROUP BY 1")
def d10_distribution(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*statistics.distribution("value"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def d11_pearson(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(statistics.pearson("l_quantity", "l_extendedprice").alias("r"))


@query("SELECT event_type, round(exp(avg(ln(1 + value))), 6) AS m FROM events GROUP BY 1")
def d13_geometric_mean(spark, d):
    return table(spark, d, "events").withColumn("v", 1 + F.col("value")).groupBy("event_type").agg(F.round(statistics.geometric_mean("v"), 6).alias("m"))


@query()
def d13_bootstrap(spark, d):
    return statistics.bootstrap_interval(table(spark, d, "events").withColumn("v", 1 + F.col("value")), "event_type", "v", 10_000)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def d15_d16_row_of_max(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))


@query("SELECT o_custkey, count(DISTINCT (o_orderstatus, o_orderpriority)) FILTER (WHERE o_totalprice > 100000) AS n FROM orders GROUP BY 1")
def d18_distinct_pairs(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct(F.when(F.col("o_totalprice") > 100000, F.struct("o_orderstatus", "o_orderpriority"))).alias("n"))


@query("SELECT event_type, nullif(sum(CAST(json_extract_string(props, '$.k') AS INT)), 0) AS k FROM events GROUP BY 1")
def d26_usage_sums(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.nullif(F.sum("k"), F.lit(0)).alias("k"))


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS seq FROM orders")
def e01_row_number(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("seq"))


@query(with_("facts", "retractions", "current") + "SELECT conv_id, ordinal FROM current")
def e03_current_version(spark, d):
    return current_facts(spark, d).select("conv_id", "ordinal")


CHANGES = "SELECT l_partkey AS source_term, l_linenumber AS changed_at, l_orderkey AS seq, l_suppkey AS old_target, l_suppkey + 1 AS new_target FROM lineitem"


@query(f"WITH c AS ({CHANGES}) SELECT source_term, coalesce(arg_max(new_target, (changed_at, seq, new_target)) FILTER (WHERE changed_at <= 2), arg_min(old_target, (changed_at, seq, old_target)) FILTER (WHERE changed_at > 2)) AS target FROM c GROUP BY 1")
def e05_gloss_as_of_h(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source_term"), F.col("l_linenumber").alias("changed_at"), F.col("l_orderkey").alias("seq"), F.col("l_suppkey").alias("old_target"), (F.col("l_suppkey") + 1).alias("new_target"))
    return versions.gloss_as_of(rows, 2)


@query("WITH t AS (SELECT *, CASE WHEN coalesce(lag(turn % 3 != 2) OVER (PARTITION BY conv_id ORDER BY turn), FALSE) THEN 0 ELSE 1 END AS b FROM conversations), g AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM t) SELECT conv_id, CAST(part AS BIGINT) AS part, count(*) AS n_pages, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, arg_min(role, turn) AS title, max(turn) AS next_url FROM g GROUP BY 1, 2")
def e06_assembly(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), "text", F.col("role").alias("title"), F.col("turn").alias("url"), F.col("turn").alias("next_url"), (F.col("turn") % 3 != 2).alias("continues"))
    return versions.assemble(rows, ["conv_id"]).select("conv_id", F.col("part").cast("long").alias("part"), "n_pages", "text", "title", "next_url")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n, strlen(text) AS b FROM documents) WHERE n > 1 AND b < 3000")
def e07_short_repeats(spark, d):
    n = F.row_number().over(W.partitionBy(F.sha2("text", 256)).orderBy("doc_id"))
    return table(spark, d, "documents").withColumn("n", n).where((F.col("n") > 1) & (F.octet_length("text") < 3000)).select("doc_id")


@query("WITH l AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM l) SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) AS INT) AS part FROM g")
def e08_islands(spark, d):
    w = W.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, d, "events").withColumn("new", ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)))
    rows = versions.islands(rows, ["user_id"], "event_id", F.col("new"))
    return rows.select("event_id", F.row_number().over(W.partitionBy("user_id", "island").orderBy("event_id")).alias("part"))


@query(with_("chapters") + "SELECT doc_id, coalesce(lead(chapter_index) OVER (PARTITION BY novel_id ORDER BY chapter_index) = chapter_index + 1, FALSE) AS has_next FROM chapters")
def e10_has_next(spark, d):
    after = F.lead("chapter_index").over(W.partitionBy("novel_id").orderBy("chapter_index"))
    return chapters(spark, d).select("doc_id", F.coalesce(after == F.col("chapter_index") + 1, F.lit(False)).alias("has_next"))


@query(with_("chapters").replace("WITH ", "WITH RECURSIVE ", 1) + ", o AS (SELECT *, row_number() OVER (PARTITION BY novel_id ORDER BY chapter_index) AS n FROM chapters), p AS (SELECT novel_id, n, CASE WHEN n_chars <= 20000 THEN n_chars ELSE 0 END AS used, CASE WHEN n_chars <= 20000 THEN 1 ELSE 0 END AS taken FROM o WHERE n = 1 UNION ALL SELECT o.novel_id, o.n, CASE WHEN used + n_chars <= 20000 THEN used + n_chars ELSE used END, CASE WHEN used + n_chars <= 20000 THEN taken + 1 ELSE taken END FROM p JOIN o ON o.novel_id = p.novel_id AND o.n = p.n + 1) SELECT novel_id, CAST(arg_max(used, n) AS BIGINT) AS used, CAST(arg_max(taken, n) AS INT) AS n_taken FROM p GROUP BY 1")
def e12_greedy_pack(spark, d):
    items = chapters(spark, d).select("novel_id", "chapter_index", F.col("doc_id").alias("item"), "n_chars")
    return versions.greedy_pack(items, ["novel_id"], ["chapter_index"], "n_chars", 20000).select("novel_id", "used", F.size("taken").alias("n_taken"))


@query()
def e14_hash_chain(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("n"), F.col("l_suppkey") % 20).alias("novel_id"), F.col("l_partkey").cast("string").alias("source_term"), F.lit(None).cast("string").alias("old_target"), F.col("l_suppkey").cast("string").alias("new_target"), F.col("l_linenumber").alias("changed_at"), "l_orderkey", "l_linenumber")
    seq = F.row_number().over(W.partitionBy("novel_id").orderBy("l_orderkey", "l_linenumber", "source_term"))
    return hashing.chain(rows.select("novel_id", seq.alias("seq"), "source_term", "old_target", "new_target", "changed_at")).select("novel_id", "seq", "prev_hash", "row_hash")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS attempt, least(300 * pow(2, least(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), 60) - 1), 3600)::DOUBLE AS wait FROM events WHERE event_type = 'error'")
def e19_j09_backoff(spark, d):
    rows = table(spark, d, "events").where("event_type = 'error'").select("event_id", "ts", F.col("user_id").alias("key"))
    return queues.attempts(rows).select("event_id", "attempt", "wait")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 50")
def f01_page(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(100).select("o_orderkey")


QUESTION = [((i * 37) % 11 - 5) / 5 for i in range(64)]
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QUESTION) + "]"


@query(f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS distance FROM embeddings WHERE vec_id <= 300 AND label = 3 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}), vec_id LIMIT 8")
def f02_gated_top_k(spark, d):
    rows = table(spark, d, "embeddings").select(F.lit(NOVEL).alias("novel_id"), F.col("vec_id").alias("chapter_index"), F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("embedding_space"))
    return retrieval.gated_top_k(rows, QUESTION, NOVEL, 300, "3").select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query("SELECT o_orderkey FROM orders ORDER BY least(CASE WHEN o_orderstatus = 'O' THEN o_orderdate END, coalesce(CASE WHEN o_orderpriority LIKE '1%' THEN o_orderdate END, TIMESTAMP '9999-12-31')), o_orderkey LIMIT 20")
def f07_least_due(spark, d):
    late = F.lit("9999-12-31").cast("timestamp")
    a, b = F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate")), F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderdate"))
    return table(spark, d, "orders").orderBy(F.least(F.coalesce(a, late), F.coalesce(b, late)), "o_orderkey").limit(20).select("o_orderkey")


@query("SELECT l_orderkey AS term, 'saved' AS kind FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'R' UNION ALL SELECT o_orderkey, 'provisional' FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_linenumber = 1 AND l_orderkey = o_orderkey)")
def g05_overlay(spark, d):
    saved = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("term"), F.lit("saved").alias("kind"), (F.col("l_returnflag") == "R").alias("deleted"))
    provisional = table(spark, d, "orders").select(F.col("o_orderkey").alias("term"), F.lit("provisional").alias("kind"))
    return versions.overlay_first(saved, provisional, "term").select("term", "kind")


@query("WITH m AS (SELECT user_id AS reader_id, 'src' || (event_id % 20) AS novel_id, CAST(event_id % 90 AS INT) AS c FROM events), k AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT reader_id, novel_id, max(c) AS current_chapter FROM m JOIN k ON source = novel_id AND c BETWEEN 1 AND n GROUP BY 1, 2")
def h01_advance_progress(spark, d):
    moves = table(spark, d, "events").select(F.col("user_id").alias("reader_id"), F.concat(F.lit("src"), F.col("event_id") % 20).alias("novel_id"), (F.col("event_id") % 90).cast("int").alias("current_chapter"))
    return mutations.advance_progress(moves.limit(0), moves, chapters(spark, d))


@query("WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem) SELECT p_partkey, p_size FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT l_partkey, CAST(l_linenumber AS INT) FROM a WHERE n = 1 AND l_partkey % 2 = 1")
def h02_insert_new(spark, d):
    existing = table(spark, d, "part").where("p_partkey % 2 = 0").select("p_partkey", "p_size")
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").cast("int").alias("p_size"), "l_orderkey", "l_suppkey")
    return mutations.insert_new(existing, rows, ["p_partkey"], F.col("l_orderkey"), F.col("p_size"), F.col("l_suppkey"))


@query("WITH g AS (SELECT 'n' || (p_partkey % 10) AS novel_id, p_partkey AS source_term, p_name AS target_term, p_size AS version, FALSE AS deleted FROM part), t AS (SELECT novel_id, max(version) AS v FROM g GROUP BY 1) SELECT g.novel_id, source_term, CASE WHEN source_term % 50 = 1 THEN 'new' ELSE target_term END AS target_term, CASE WHEN source_term % 50 IN (1, 2) THEN v + 1 ELSE version END AS version, source_term % 50 = 2 AS deleted FROM g JOIN t USING (novel_id)")
def h05_correct_term(spark, d):
    g = table(spark, d, "part").select(F.concat(F.lit("n"), F.col("p_partkey") % 10).alias("novel_id"), F.col("p_partkey").alias("source_term"), F.col("p_name").alias("target_term"), F.col("p_size").alias("version"), F.lit(False).alias("deleted"))
    c = g.where("source_term % 50 in (1, 2)").select("novel_id", "source_term", F.when(F.col("source_term") % 50 == 1, "new").alias("new_target"), F.lit(True).alias("is_change"))
    return mutations.correct_term(g, c)


@query("WITH a AS (SELECT source AS novel_id, nullif(doc_id % 97, 5) AS source_url, sha256(text) AS raw_hash, doc_id AS arrival FROM documents), u AS (SELECT *, row_number() OVER (PARTITION BY novel_id, source_url ORDER BY arrival) AS n FROM a), h AS (SELECT *, row_number() OVER (PARTITION BY novel_id, raw_hash ORDER BY arrival) AS m FROM u WHERE n = 1 OR source_url IS NULL) SELECT novel_id, arrival FROM h WHERE m = 1")
def h15_ingest_dedup(spark, d):
    a = table(spark, d, "documents").select(F.col("source").alias("novel_id"), F.nullif(F.col("doc_id") % 97, F.lit(5)).alias("source_url"), F.sha2("text", 256).alias("raw_hash"), F.col("doc_id").alias("arrival"))
    return mutations.ingest(a.limit(0), a).select("novel_id", "arrival")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def c28_h16_cascade(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("novel_id"))
    return mutations.cascade({"l": table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "novel_id")}, gone)["l"].select(F.col("novel_id").alias("l_orderkey"), "l_linenumber")


@query("SELECT doc_id, item_id AS alias_id, instr(d.text, b.text) - 1 AS char_start FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def t01_scan_mentions(spark, d):
    """Benchmark passages as names, in a language without word boundaries; each first occurrence."""
    aliases = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("alias_id"), F.col("text").alias("surface"))
    found = scan.scan_mentions(table(spark, d, "documents").select("doc_id", "text", F.lit("zh").alias("lang")), aliases)
    rows = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.alias_id").cast("long").alias("alias_id"), F.col("s.char_start").cast("long").alias("char_start"))
    return rows.groupBy("doc_id", "alias_id").agg(F.min("char_start").alias("char_start"))


def frequent_words(spark, d, most: int = 3000):
    """The most frequent words of over four characters, as names for the scan."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("surface")).where(F.length("surface") > 4)
    return words.groupBy("surface").count().orderBy(F.desc("count"), "surface").limit(most).select(F.col("surface").alias("alias_id"), "surface")


@query()
def t01_scan_words(spark, d):
    """Three thousand frequent words as names: the scan at work."""
    found = scan.scan_mentions(table(spark, d, "documents").select("doc_id", "text", "lang"), frequent_words(spark, d))
    return found.select("doc_id", F.size("spans").alias("n_spans"))


@query()
def t05_chunks(spark, d):
    found = chunks.chunk_text(table(spark, d, "documents").select("doc_id", "text", "lang"), 400)
    return found.select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.ordinal", "c.start", "c.end")


@query("SELECT doc_id, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) // 4 + length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS tokens FROM documents")
def t34_approx_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.approx_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS plain FROM documents")
def t30_normalized(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalized_rendering(F.col("text")).alias("plain"))


@query("SELECT doc_id, CAST(pos AS INT) AS pos FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE length(line) >= 48 OR (length(line) >= 24 AND contains('.!?…。！？」』”\"’''）)।॥۔؟։።', right(line, 1)))")
def t23_prose_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(tx.is_prose(F.trim("line"))).select("doc_id", "pos")


@query("SELECT doc_id, sha256(concat_ws(chr(31), 'translate', sha256(text), lang)) AS key FROM documents")
def t35_idempotency_key(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.idempotency_key(F.lit("translate"), F.sha2("text", 256), F.col("lang")).alias("key"))


@query()
def t17_hash_content(spark, d):
    return hashing.hash_content(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "sha256", "simhash")


@query()
def t18_near_duplicates(spark, d):
    marks = hashing.content_marks(table(spark, d, "documents"))
    return hashing.near_by_bands(marks.groupBy("mark").agg(F.min("doc_id").alias("id")))


@query()
def a10_extract_pages(spark, d):
    return pages_source.extract(table(spark, d, "pages")).select("page_id", "page.title", F.size("page.paragraphs").alias("n_paragraphs"), "page.next_url")


@query()
def a14_preview(spark, d):
    return pages_source.preview(pages_source.extract(table(spark, d, "pages")))


ROBOTS = "# comment\nUser-agent: other\nDisallow: /en/\nUser-agent: *\nDisallow: /fr/1\nCrawl-delay: 2\nDisallow:\nDisallow: /de/ # all"


@query("WITH u AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_extract(url, '://[^/]+([^?#]*)', 1) AS path FROM pages) SELECT page_id FROM u WHERE NOT (host LIKE 'm.%' AND (starts_with(path, '/fr/1') OR starts_with(path, '/de/')))")
def a12_a13_robots(spark, d):
    urls = table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PATH")).alias("path"))
    files = urls.where(F.col("host").startswith("m.")).select("host", F.lit(ROBOTS).alias("body")).distinct()
    return pages_source.allowed(urls, pages_source.robots_rules(files)).select("page_id")


@query("SELECT to_json(r) IS NOT NULL AS ok, count(*) AS n FROM region r GROUP BY 1")
def a16_export_rows(spark, d):
    return table(spark, d, "region").select(F.to_json(F.struct("*")).isNotNull().alias("ok")).groupBy("ok").agg(F.count("*").alias("n"))


QUEUE = "SELECT event_id AS pos, 'u' || user_id AS novel_id, CAST(event_id % 40 AS INT) AS chapter_index, event_type = 'purchase' AS priority, event_type = 'view' AS enrichment FROM events"


@query(f"WITH q AS ({QUEUE}), w AS (SELECT *, 4 * CAST(novel_id = 'u7' AS INT) + 2 * CAST(priority AS INT) + CAST(NOT enrichment AS INT) AS rank FROM q WHERE novel_id NOT IN ('u1', 'u2')), b AS (SELECT * FROM w ORDER BY rank DESC, pos LIMIT 1) SELECT w.pos, w.chapter_index FROM w JOIN b ON w.rank = b.rank AND w.novel_id = b.novel_id ORDER BY CASE WHEN b.priority THEN w.pos ELSE w.chapter_index END, w.pos LIMIT 1")
def j01_claim(spark, d):
    q = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("u"), F.col("user_id")).alias("novel_id"), (F.col("event_id") % 40).cast("int").alias("chapter_index"), (F.col("event_type") == "purchase").alias("priority"), (F.col("event_type") == "view").alias("enrichment"))
    return queues.claim(q, spark.range(1).select(F.explode(F.array(F.lit("u1"), F.lit("u2"))).alias("novel_id")), "u7").select("pos", "chapter_index")


@query("SELECT user_id AS key, max(floor(epoch(ts)))::BIGINT AS last FROM events GROUP BY 1 HAVING 1706580000 - max(floor(epoch(ts))) >= 7200")
def j07_reaper(spark, d):
    return queues.expired(events(spark, d).select(F.col("user_id").alias("key"), F.col("s").alias("ts")), 1706580000, 7200)


@query("SELECT event_id, max(floor(epoch(ts))::BIGINT + CAST(json_extract_string(props, '$.k') AS INT)) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) AS until FROM events")
def j10_cooldown(spark, d):
    rows = events(spark, d).select("event_id", F.col("user_id").alias("key"), F.col("s").alias("ts"), F.col("k").alias("ttl"))
    return queues.cooldown(rows).select("event_id", "until")


@query()
def j11_limit(spark, d):
    """Three calls a day and one at a time, which lasts some hours and a day at most."""
    rows = events(spark, d).select("event_id", F.col("user_id").alias("key"), F.col("s").cast("double").alias("ts"), F.when(F.col("event_id") % 5 > 0, F.col("s") + F.col("k") * 3600.0).alias("done"))
    return queues.limit_replay(rows, 3, 86400.0, 86400.0).select("event_id", "key", "ts", "allowed")


@query()
def j12_permits(spark, d):
    """Three permits by kind of event; every event asks for one, and some settle that of the event before."""
    settle = F.col("user_id") % 3 == 0
    rows = events(spark, d).select("event_id", F.col("event_type").alias("key"), F.col("s").cast("double").alias("ts"), F.when(settle, "settle").otherwise("reserve").alias("action"), F.when(settle, F.col("user_id") - 1).otherwise(F.col("user_id")).alias("reservation_id"))
    return queues.permits(rows, 3, 7200.0).select("event_id", "outcome")
