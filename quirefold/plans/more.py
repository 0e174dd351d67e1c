"""Further queries of the catalog: states, name rules, look-ups and groups, each with its SQL."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.functions import gate
from quirefold.functions import text as tx
from quirefold.operators import rules, scan, versions
from quirefold.plans.domain import chapters, facts, retractions, table, with_
from quirefold.plans.registry import query

NOW = "1996-01-01"


@query(with_("chapters") + "SELECT doc_id FROM chapters WHERE novel_id = 'src3' AND chapter_index <= 20")
def b05_gated_view(spark, d):
    """SQL over a gated view, without a filter of its own."""
    gate.register_views(spark, {"quirefold_gated": chapters(spark, d)}, "src3", 20)
    return spark.sql("SELECT doc_id FROM quirefold_gated")


_STATE = "SELECT o_orderkey, o_orderkey % 5 AS ea, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS er, o_custkey % 5 AS pa, CASE WHEN o_custkey % 4 = 0 THEN o_orderdate END AS pr, o_orderstatus = 'F' AS ready, CASE WHEN o_orderkey % 7 > 2 THEN o_orderkey % 7 END AS fc, o_orderkey % 11 = 0 AS discarded FROM orders"


def _state(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey", (F.col("o_orderkey") % 5).alias("enrichment_attempts"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("enrichment_retry_at"), (F.col("o_custkey") % 5).alias("provider_attempts"),
        F.when(F.col("o_custkey") % 4 == 0, F.col("o_orderdate")).alias("provider_retry_at"), (F.col("o_orderstatus") == "F").alias("ready"), F.when(F.col("o_orderkey") % 7 > 2, F.col("o_orderkey") % 7).alias("facts_count"), (F.col("o_orderkey") % 11 == 0).alias("discarded"),
    )


@query(
    f"WITH c AS ({_STATE}), f AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'provider_retry_exhausted' ELSE 'stage_failed' END AS code, l_shipdate AS t, l_linenumber AS id FROM lineitem WHERE l_quantity > 30), "
    "l AS (SELECT o_orderkey, arg_max(code, (t, id, code)) AS detail FROM c JOIN f ON l_orderkey = o_orderkey WHERE (pa >= 3 AND pr IS NULL AND code = 'provider_retry_exhausted') OR (ea >= 3 AND er IS NULL AND code <> 'provider_retry_exhausted') GROUP BY 1) "
    f"SELECT o_orderkey, CASE WHEN (er IS NOT NULL AND ea < 3) OR (pr IS NOT NULL AND pa < 3) THEN 'processing' WHEN detail IS NOT NULL THEN CASE WHEN least(er, pr) > TIMESTAMP '{NOW}' AND detail <> 'provider_retry_exhausted' THEN 'pending' ELSE 'failed' END WHEN ready AND fc IS NOT NULL THEN 'ready' ELSE 'pending' END AS state, detail FROM c LEFT JOIN l USING (o_orderkey)"
)
def b10_facts_state(spark, d):
    failures = table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", rules.EXHAUSTED).otherwise("stage_failed").alias("error_code"), F.col("l_shipdate").alias("occurred_at"), F.col("l_linenumber").alias("id"))
    return rules.facts_state(_state(spark, d), failures, ["o_orderkey"], 3, F.lit(NOW).cast("timestamp"))


@query("SELECT o_orderkey, CASE WHEN o_custkey >= 20 AND o_custkey < 60 AND o_orderstatus IN ('O', 'P') THEN 'queued' ELSE o_orderstatus END AS status FROM orders")
def b15_range_claim(spark, d):
    claimed = (F.col("o_custkey") >= 20) & (F.col("o_custkey") < 60) & F.col("o_orderstatus").isin("O", "P")
    return table(spark, d, "orders").select("o_orderkey", F.when(claimed, "queued").otherwise(F.col("o_orderstatus")).alias("status"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN source END, CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN doc_id % 2 = 0 THEN 'first' END, CAST(doc_id AS VARCHAR)) AS name FROM documents")
def b18_display_name(spark, d):
    i = F.col("doc_id")
    candidates = F.when(i % 2 == 0, F.array(F.lit("first"), F.lit("second"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.when(i % 5 == 0, F.col("source")), F.when(i % 3 == 0, F.col("lang")), F.get(candidates, F.lit(0)), i.cast("string")).alias("name"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'filled' ELSE url END AS url, CASE WHEN page_id % 4 = 0 THEN 'new' ELSE CAST(length(html) AS VARCHAR) END AS part FROM pages")
def b20_b21_partial_update(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.struct(F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url")).alias("url"), F.length("html").cast("string").alias("part")).alias("meta"))
    blank = F.coalesce(F.col("meta.url"), F.lit("")) == ""
    rows = rows.withColumn("meta", F.when(blank, F.col("meta").withField("url", F.lit("filled"))).otherwise(F.col("meta")))
    return rows.select("page_id", "meta.url", F.coalesce(F.when(F.col("page_id") % 4 == 0, "new"), F.col("meta.part")).alias("part"))


@query(f"WITH c AS ({_STATE}) SELECT o_orderkey FROM c WHERE (NOT discarded AND er <= TIMESTAMP '{NOW}' AND ea < 4 AND pr IS NULL AND pa < 3) OR (pr <= TIMESTAMP '{NOW}' AND pa < 3 AND (NOT ready OR NOT discarded))")
def b22_due_retries(spark, d):
    return _state(spark, d).where(rules.due(F.lit(NOW).cast("timestamp"), 4, 3)).select("o_orderkey")


@query("WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS a, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents) SELECT doc_id, CAST(pos AS INT) AS pos FROM t WHERE length(trim(a, ' ')) BETWEEN 2 AND 80 AND NOT regexp_matches(a, '[\\n\\r。！？；：，、]')")
def b27_usable_term(spark, d):
    """Every line as a term and its own rendering, in languages that may keep Han characters."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(tx.usable_term(F.col("line"), F.col("line"), F.lit(True))).select("doc_id", "pos")


@query("SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS term, p_type AS display FROM part) WHERE length(trim(term, ' ')) BETWEEN 1 AND 40 AND NOT regexp_matches(term, '[0-9]') AND length(trim(display, ' ')) > 0 AND length(display) <= 80")
def b28_source_names(spark, d):
    term = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type"))
    return table(spark, d, "part").where(rules.usable_source_name(term, F.col("p_type"))).select("p_partkey")


@query("WITH n AS (SELECT doc_id, text, unnest(string_split(text, ' ')) AS name FROM documents) SELECT DISTINCT doc_id, name FROM n WHERE name = trim(name, ' ') AND length(name) BETWEEN 1 AND 80 AND NOT regexp_matches(name, '[\\n\\r!?。！？]') AND NOT ends_with(name, '.') AND contains(text, name)")
def b29_discovered_names(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(rules.discovered_names(F.array_distinct(F.split("text", " ")), F.col("text"))).alias("name"))


@query("SELECT l_orderkey, l_linenumber, 'quantity' AS violation FROM lineitem WHERE NOT (l_quantity BETWEEN 1 AND 45) UNION ALL SELECT l_orderkey, l_linenumber, 'discount' FROM lineitem WHERE NOT l_discount < 0.09")
def b31_violations(spark, d):
    checks = F.array(F.when(~F.col("l_quantity").between(1, 45), "quantity"), F.when(~(F.col("l_discount") < 0.09), "discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.array_compact(checks)).alias("violation"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN 'character' END, CASE WHEN c_custkey % 3 = 0 THEN 'place' END, CASE WHEN c_custkey % 2 = 0 THEN 'item' END) AS kind FROM customer")
def b32_subject_kind(spark, d):
    i, role = F.col("c_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", "chinese_person").otherwise("personal_title")
    return table(spark, d, "customer").select("c_custkey", rules.subject_kind(role, F.when(i % 3 == 0, "place"), F.when(i % 2 == 0, "item")).alias("kind"))


@query("SELECT p_partkey AS term, 'own' AS via FROM part WHERE p_size > 25 UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size > 25 AND p_partkey = s_suppkey)")
def c08_union_anti(spark, d):
    own = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("term"), F.lit("own").alias("via"))
    return own.unionByName(versions.without(table(spark, d, "supplier").select(F.col("s_suppkey").alias("term"), F.lit("supplier").alias("via")), own, ["term"]))


@query("SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'O' AND p.o_orderkey <> o.o_orderkey)")
def c09_only_pending(spark, d):
    return rules.only_pending(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "O").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT s_suppkey FROM supplier)")
def c10_not_busy(spark, d):
    busy = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")).unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("o_custkey")))
    return versions.without(table(spark, d, "orders"), busy, ["o_custkey"]).select("o_orderkey")


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_suppkey FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND b.l_quantity > 25 WHERE a.l_linenumber <= 2")
def c12_exact_span(spark, d):
    spans = table(spark, d, "lineitem").where("l_linenumber <= 2").select("l_orderkey", "l_linenumber")
    return spans.join(table(spark, d, "lineitem").where("l_quantity > 25").select("l_orderkey", "l_linenumber", "l_suppkey"), ["l_orderkey", "l_linenumber"], "left")


@query("SELECT DISTINCT t.p_name AS title FROM part t JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS n FROM part WHERE p_size < 20) ON contains(t.p_name, n) AND n <> t.p_name")
def b30_c14_title_holds_name(spark, d):
    names = table(spark, d, "part").where("p_size < 20").select(F.substring_index("p_name", " ", 1).alias("term")).distinct()
    titles = table(spark, d, "part").select(F.col("p_name").alias("text")).distinct()
    return scan.presence(titles, names).where("term <> text").select(F.col("text").alias("title")).distinct()


@query(with_("facts") + "SELECT conv_id, ordinal, subject FROM (SELECT conv_id, ordinal, unnest(subjects) AS subject FROM facts) WHERE subject IN (SELECT 's' || n FROM range(0, 9) t(n))")
def c19_visible_refs(spark, d):
    visible = spark.range(9).select(F.concat(F.lit("s"), "id").alias("subject"))
    return facts(spark, d).select("conv_id", "ordinal", F.explode("subjects").alias("subject")).join(visible, "subject", "left_semi").select("conv_id", "ordinal", "subject")


@query("SELECT c_custkey, CASE WHEN count(o_orderkey) = 1 THEN min(o_orderkey) END AS page FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority LIKE '1%' GROUP BY 1")
def c20_unique_match(spark, d):
    pages = versions.unambiguous(table(spark, d, "orders").where("o_orderpriority like '1%'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderkey")
    return table(spark, d, "customer").join(pages, "c_custkey", "left").select("c_custkey", F.col("o_orderkey").alias("page"))


_PARAS = "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos FROM conversations"


@query(f"WITH s AS ({_PARAS}), d AS ({_PARAS} WHERE role = 'user'), n AS (SELECT conv_id, ns, nd FROM (SELECT conv_id, count(*) AS ns FROM s GROUP BY 1) JOIN (SELECT conv_id, count(*) AS nd FROM d GROUP BY 1) USING (conv_id)) SELECT d.conv_id, d.pos AS display_pos, s.pos AS source_pos FROM d JOIN n ON d.conv_id = n.conv_id JOIN s ON s.conv_id = d.conv_id AND abs(s.pos - round_even(d.pos * (ns / nd), 0)) <= 1")
def c22_proportional_window(spark, d):
    rows = table(spark, d, "conversations")
    pos = (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).alias("pos")
    return rules.aligned_positions(rows.where("role = 'user'").select("conv_id", pos), rows.select("conv_id", pos), "conv_id", 1)


@query("SELECT a.event_id // 2 AS pair, round(a.value - b.value, 4) AS difference FROM events a JOIN events b ON a.event_id // 2 = b.event_id // 2 AND a.event_type = b.event_type WHERE a.event_id % 2 = 0 AND b.event_id % 2 = 1")
def c23_pairs(spark, d):
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 2).alias("pair"), "event_type", "value", (F.col("event_id") % 2).alias("arm"))
    both = e.where("arm = 0").join(e.where("arm = 1").select("pair", "event_type", F.col("value").alias("other")), ["pair", "event_type"])
    return both.select("pair", F.round(F.col("value") - F.col("other"), 4).alias("difference"))


@query("SELECT n_nationkey, CAST(i AS INT) AS i FROM nation, range(1, 6) t(i) WHERE i <= 1 + n_nationkey % 5")
def c24_series(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(1), (1 + F.col("n_nationkey") % 5).cast("int"))).alias("i"))


@query("SELECT o_orderkey, coalesce(n_name, 'all') AS mode FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 2")
def c26_c29_dispatch(spark, d):
    control = table(spark, d, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    active = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return table(spark, d, "orders").join(active, "o_custkey").join(control, "c_nationkey", "left").select("o_orderkey", F.coalesce("n_name", F.lit("all")).alias("mode"))


@query("SELECT p_partkey, coalesce(m, p_size) AS size FROM part LEFT JOIN (SELECT l_partkey, CAST(max(l_quantity) AS INT) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey")
def b33_c27_join_update(spark, d):
    new = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").cast("int").alias("m"))
    return table(spark, d, "part").join(new, "p_partkey", "left").select("p_partkey", F.coalesce("m", "p_size").alias("size"))


@query("SELECT coalesce((SELECT max(o_orderkey) FROM orders), 0) - coalesce((SELECT max(l_partkey) FROM lineitem), 0) AS ahead, EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS any_negative")
def d07_d09_scalars(spark, d):
    top = table(spark, d, "orders").agg(F.max("o_orderkey").alias("a"), F.coalesce(F.bool_or(F.col("o_totalprice") < 0), F.lit(False)).alias("any_negative"))
    low = table(spark, d, "lineitem").agg(F.max("l_partkey").alias("b"))
    # two frames of one row
    return top.crossJoin(F.broadcast(low)).select((F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("ahead"), "any_negative")


@query("SELECT user_id, round(median(value) FILTER (WHERE event_type = 'view') / median(value) FILTER (WHERE event_type = 'click'), 6) AS ratio, count(*) FILTER (WHERE event_type = 'error') AS n_error, round(sum(value), 2) AS total FROM events GROUP BY 1")
def d12_d14_arms(spark, d):
    of = lambda t: F.percentile(F.when(F.col("event_type") == t, F.col("value")), F.lit(0.5))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.try_divide(of("view"), of("click")), 6).alias("ratio"), F.count_if(F.col("event_type") == "error").alias("n_error"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT user_id, '{' || string_agg('\"' || event_type || '\":' || n, ',' ORDER BY event_type) || '}' AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def d17_object_agg(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n"))))).alias("counts"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 10 <> 0 AND CAST(json_extract_string(props, '$.k') AS INT) IS NOT NULL GROUP BY 1")
def d19_d20_lenient_depth(spark, d):
    """Queue depth by kind of messages that parse; a malformed one costs only itself."""
    body = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props"))
    return table(spark, d, "events").withColumn("m", F.from_json(body, "k int")).where("m.k is not null").groupBy("event_type").agg(F.count("*").alias("n"))


# the index of a book: its lines, which mostly open alike, and the documents' own lines
_INDEXED = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat_ws(chr(10), 'Chapter number 1', 'Chapter number 2', 'short', 'Chapter number 3 and on', 'Chapter number 4') WHEN doc_id % 3 = 1 THEN concat_ws(chr(10), 'Chapter number 1', 'Chapter number 2', 'Chapter number 3', 'a', 'b', 'Chapter number 4', 'c') ELSE text END AS text FROM documents"


@query(f"WITH t AS ({_INDEXED}), l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM t), a AS (SELECT doc_id, count(*) AS lines FROM l WHERE line <> '' GROUP BY 1), s AS (SELECT doc_id, left(line, 10) AS stem, count(*) AS n FROM l WHERE length(line) >= 10 GROUP BY 1, 2) SELECT doc_id, max(n) AS top, any_value(lines) AS lines FROM s JOIN a USING (doc_id) GROUP BY 1 HAVING max(n) >= 4 AND max(n) * 10 >= 6 * any_value(lines)")
def d22_repeated_stem(spark, d):
    texts = table(spark, d, "documents").select("doc_id", F.expr(_INDEXED[len("SELECT doc_id, ") : -len(" AS text FROM documents")].replace("chr(10)", "char(10)")).alias("text"))
    return rules.repeated_stem(texts, "doc_id").select("doc_id", "top", "lines")


@query("SELECT o_custkey, count(DISTINCT (o_orderstatus, o_orderpriority)) = 1 AS consistent, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1")
def d23_d25_identities(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg((F.count_distinct(F.struct("o_orderstatus", "o_orderpriority")) == 1).alias("consistent"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("statuses"))


@query(with_("facts", "retractions", "current") + "SELECT novel_id, chapter_index, prompt_version, count(*) AS n FROM current GROUP BY 1, 2, 3")
def d27_latest_count(spark, d):
    keys = ["novel_id", "chapter_index", "prompt_version", "ordinal"]
    rows = versions.without(versions.current_version(facts(spark, d), ["novel_id", "chapter_index"], "prompt_version"), retractions(spark, d), keys)
    return rows.groupBy("novel_id", "chapter_index", "prompt_version").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, o_orderpriority, max(o_orderkey) AS chapter, max(o_orderdate) AS updated_at FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def d28_merge_progress(spark, d):
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return table(spark, d, "orders").join(owners, "o_custkey").groupBy("c_nationkey", "o_orderpriority").agg(F.max("o_orderkey").alias("chapter"), F.max("o_orderdate").alias("updated_at"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def e02_e04_latest(spark, d):
    return versions.latest(table(spark, d, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id")


_ATTR = "SELECT event_id AS id, user_id, CAST(event_id % 40 AS INT) AS source_chapter, CAST(event_id % 23 AS INT) AS valid_from, value AS confidence, CASE WHEN event_id % 6 = 0 THEN event_id - 3 END AS supersedes FROM events"


@query(f"WITH k AS (SELECT * FROM ({_ATTR}) WHERE source_chapter <= 20 AND valid_from <= 20) SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY valid_from DESC, source_chapter DESC, confidence DESC, id DESC) AS n FROM k WHERE id NOT IN (SELECT supersedes FROM k WHERE supersedes IS NOT NULL)) WHERE n = 1")
def e09_as_of_attribute(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select(i.alias("id"), "user_id", (i % 40).cast("int").alias("source_chapter"), (i % 23).cast("int").alias("valid_from"), F.col("value").alias("confidence"), F.when(i % 6 == 0, i - 3).alias("supersedes"))
    return rules.as_of_attribute(rows, 20, ["user_id"]).select("user_id", "id")


@query("SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def e15_first_occurrence(spark, d):
    return versions.first_by(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], F.col("l_orderkey"), F.col("l_linenumber")).select("l_partkey", "l_suppkey", "l_orderkey")


@query("SELECT conv_id, turn, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def e20_previous_body(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag(F.sha2("text", 256)).over(W.partitionBy("conv_id").orderBy("turn")).alias("previous"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey < 3 THEN 'R' || n_regionkey ELSE 'someone' END || ' is kind to ' || n_name AS text FROM nation")
def c18_dereference(spark, d):
    names = F.map_from_arrays(F.array(F.lit("0"), F.lit("1"), F.lit("2")), F.array(F.lit("R0"), F.lit("R1"), F.lit("R2")))
    return table(spark, d, "nation").select("n_nationkey", tx.dereference(F.concat(F.lit("⟦"), "n_regionkey", F.lit("⟧ is kind to "), "n_name"), names).alias("text"))
