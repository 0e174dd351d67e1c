"""Queries of chapters at work and of sets, with the SQL they are checked against."""

from pyspark.sql import functions as F

from quirefold.functions import text as tx
from quirefold.operators import alignment, chapterstates
from quirefold.plans.domain import chapters, events, table, with_
from quirefold.plans.registry import query
from quirefold.sources import sites, tree

_RETRIES = with_("ev") + """,
f AS (SELECT event_id, user_id AS key, s, CASE event_id % 4 WHEN 0 THEN 'stage' WHEN 1 THEN 'shared' ELSE 'provider' END AS kind, CAST(k AS DOUBLE) - 20 AS hint, event_id % 16 = 4 AS manual FROM ev),
a AS (SELECT *, sum(CAST(kind = 'stage' AS INT)) OVER (PARTITION BY key ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS stages FROM f),
b AS (SELECT *, sum(CAST(kind = 'provider' AS INT)) OVER (PARTITION BY key, stages ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS calls FROM a)
SELECT event_id, CAST(CASE WHEN kind = 'stage' THEN least(stages, 5) ELSE calls END AS INT) AS attempt,
CASE WHEN kind = 'shared' THEN 'scheduled' WHEN kind = 'stage' THEN CASE WHEN stages >= 5 THEN 'exhausted' WHEN manual THEN 'manual' ELSE 'scheduled' END WHEN calls >= 5 THEN 'exhausted' ELSE 'scheduled' END AS outcome,
CASE WHEN kind = 'shared' THEN greatest(coalesce(hint, 0), 0) WHEN kind = 'stage' THEN CASE WHEN stages < 5 AND NOT manual THEN least(300 * pow(2, stages - 1), 3600) END WHEN calls < 5 THEN greatest(60 * pow(2, calls - 1), coalesce(hint, 0)) END :: DOUBLE AS wait FROM b
"""


@query(_RETRIES)
def j09_retry_schedules(spark, d):
    """Failures of stages and providers, and shared cool-downs, of every user's log."""
    n = F.col("event_id")
    kind = F.when(n % 4 == 0, "stage").when(n % 4 == 1, "shared").otherwise("provider")
    log = events(spark, d).select("event_id", F.col("user_id").alias("key"), F.col("s").alias("ts"), kind.alias("kind"), (F.col("k").cast("double") - 20).alias("hint"), (n % 16 == 4).alias("manual"))
    return chapterstates.retries(log).select("event_id", "attempt", "outcome", "wait")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN true ELSE o_orderstatus = 'P' END AS discarded, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 5 END AS attempts, CASE WHEN o_custkey % 2 <> 0 OR o_orderkey % 3 <> 0 THEN o_orderpriority END AS category FROM orders")
def h13_paused(spark, d):
    """Even customers pause their orders; those that have their facts stay as they are."""
    n = F.col("o_custkey") % 5
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "P").alias("enrichment_discarded"), n.alias("enrichment_attempts"), n.alias("provider_retry_attempts"), F.col("o_orderdate").alias("enrichment_retry_at"), F.col("o_orderdate").alias("provider_retry_at"), F.col("o_orderpriority").alias("provider_retry_category"), F.when(F.col("o_orderkey") % 3 != 0, 4).alias("facts_count"))
    return chapterstates.paused(rows, F.col("o_custkey") % 2 == 0, True).select("o_orderkey", F.col("enrichment_discarded").alias("discarded"), F.col("enrichment_attempts").alias("attempts"), F.col("provider_retry_category").alias("category"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 AND p_size > 20 THEN 'new' ELSE p_brand END AS choice FROM part")
def h14_refreshed(spark, d):
    """Pending choices are made anew only from the chapter where their term was first seen."""
    size = F.col("p_size")
    reviews = table(spark, d, "part").select(F.lit("n").alias("novel_id"), F.col("p_partkey").alias("source_term"), F.when(size % 3 == 0, "pending").otherwise("approved").alias("status"), size.alias("first_seen_chapter"), F.array("p_brand").alias("candidates"), F.lit("r").alias("reason"))
    plans = reviews.where("source_term % 2 = 0").select("novel_id", "source_term", F.greatest("first_seen_chapter", F.lit(21)).alias("chapter"), F.array(F.lit("new")).alias("candidates"), F.lit("s").alias("reason"))
    return chapterstates.refreshed(reviews, plans).select(F.col("source_term").alias("p_partkey"), F.get("candidates", F.lit(0)).alias("choice"))


@query("""WITH c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'translate' WHEN 1 THEN 'facts' ELSE 'extract' END AS stage, CASE WHEN p_size > 40 THEN p_brand WHEN p_size > 35 THEN '' END AS t, CASE WHEN p_size % 5 = 0 THEN p_type END AS f, CASE WHEN p_size % 7 = 0 THEN p_name END AS e, CASE WHEN p_size % 2 = 0 THEN 'one' ELSE '' END AS single, CASE WHEN p_size % 11 = 0 THEN 'cf' END AS cf FROM part)
SELECT p_partkey, CASE WHEN t IS NOT NULL OR f IS NOT NULL OR e IS NOT NULL THEN CASE stage WHEN 'translate' THEN coalesce(nullif(t, ''), 'ct') WHEN 'facts' THEN coalesce(f, cf, e, 'ce') ELSE coalesce(e, 'ce') END WHEN single <> '' THEN single ELSE CASE stage WHEN 'translate' THEN 'ct' WHEN 'facts' THEN coalesce(cf, 'ce') ELSE 'ce' END END AS model FROM c""")
def b33_stage_models(spark, d):
    """A book's models by stage or its only one, before the configured ones."""
    n, size = F.col("p_partkey"), F.col("p_size")
    stage = F.when(n % 3 == 0, "translate").when(n % 3 == 1, "facts").otherwise("extract")
    own = {"translate": F.when(size > 40, F.col("p_brand")).when(size > 35, ""), "facts": F.when(size % 5 == 0, F.col("p_type")), "extract": F.when(size % 7 == 0, F.col("p_name"))}
    config = {"translate": F.lit("ct"), "facts": F.when(size % 11 == 0, "cf"), "extract": F.lit("ce")}
    return table(spark, d, "part").select("p_partkey", chapterstates.model_for(stage, own, F.when(size % 2 == 0, "one").otherwise(""), config).alias("model"))


@query("""WITH s AS (SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' WHEN 2 THEN 'processing' WHEN 3 THEN 'pending' END AS state, o_orderkey % 7 = 0 AS discarded, o_orderkey % 5 = 0 AS retry, o_orderkey % 11 = 0 AS exhausted, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END AS n FROM orders)
SELECT o_orderkey, CASE WHEN state IS NULL THEN 'quiet' WHEN discarded THEN 'quiet' WHEN retry THEN 'warn' WHEN exhausted OR state = 'failed' THEN 'bad' WHEN state <> 'ready' THEN 'live' ELSE 'quiet' END AS tone,
CASE WHEN state IS NULL THEN 'Checking…' WHEN discarded THEN 'Paused' WHEN retry OR exhausted OR state = 'failed' THEN NULL WHEN state = 'processing' THEN 'Finding names and facts…' WHEN state <> 'ready' THEN 'Waiting to find names and facts…' WHEN n IS NULL THEN 'Ready' ELSE 'Ready · ' || n || CASE WHEN n = 1 THEN ' fact' ELSE ' facts' END || ' for the wiki' END AS text,
state IS NOT NULL AND (discarded OR (NOT retry AND (exhausted OR state = 'failed'))) AS retryable, state IS NOT NULL AND NOT retry AND (state IN ('ready', 'failed') OR discarded) AS terminal, CASE WHEN NOT retry AND state = 'processing' THEN 8000 ELSE 20000 END AS poll,
CASE WHEN state = 'ready' THEN 'Ready' WHEN state = 'failed' THEN 'Waiting' WHEN o_orderkey % 2 = 0 THEN 'After translation' WHEN state = 'processing' THEN 'Building' ELSE 'Waiting' END AS feature FROM (SELECT * REPLACE (state AS state) FROM s)""")
def l07_facts_labels(spark, d):
    n = F.col("o_orderkey")
    state = F.when(F.col("o_custkey") % 5 == 0, "ready").when(F.col("o_custkey") % 5 == 1, "failed").when(F.col("o_custkey") % 5 == 2, "processing").when(F.col("o_custkey") % 5 == 3, "pending")
    label = chapterstates.facts_label(state, n % 7 == 0, F.when(n % 5 == 0, F.col("o_orderdate")), n % 11 == 0, F.when(n % 3 > 0, n % 4))
    status = F.when((state == "failed") | (n % 2 == 1), "done").otherwise("error")
    feature = chapterstates.features_label(F.when(state == "ready", "done"), status, F.coalesce(state == "processing", F.lit(False)))
    return table(spark, d, "orders").select(n, label.alias("l"), feature["label"].alias("feature")).select("o_orderkey", "l.*", "feature")


@query(with_("chapters") + "SELECT novel_id, count(DISTINCT lang) AS n_langs, count(DISTINCT n_chars % 10) AS n_terms FROM chapters GROUP BY 1")
def d04_distinct_terms(spark, d):
    return chapters(spark, d).groupBy("novel_id").agg(F.count_distinct("lang").alias("n_langs"), F.count_distinct(F.col("n_chars") % 10).alias("n_terms"))


@query("WITH s AS (SELECT l_orderkey, list_distinct(list(l_suppkey % 4)) AS a, list_distinct(list(l_partkey % 4)) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, len(list_intersect(a, b)) = len(a) AND len(a) = len(b) AS same, array_to_string(list_sort(list_distinct(a || b)), ',') AS merged FROM s")
def d23_d24_sets(spark, d):
    """Whether two sets of an order's lines are equal, and both merged in order."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 4).alias("a"), F.collect_set(F.col("l_partkey") % 4).alias("b"))
    same = (F.size(F.array_except("a", "b")) == 0) & (F.size(F.array_except("b", "a")) == 0)
    return rows.select("l_orderkey", same.alias("same"), F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("merged"))


@query("SELECT page_id, url || CASE WHEN page_id % 4 = 3 AND page_id % 7 > page_id % 3 THEN ' (' || (page_id % 7 + 1) || '/' || (page_id % 3 + 1) || ')' ELSE '' END AS title, page_id % 4 = 1 OR (page_id % 4 = 3 AND page_id % 7 < page_id % 3) AS continues FROM pages")
def t28_title_parts(spark, d):
    """Titles that count their parts: a last part, one with more to come, a plain one, and one that may count wrongly."""
    n = F.col("page_id")
    title = F.when(n % 4 == 0, F.concat("url", F.lit(" (3 / 3)"))).when(n % 4 == 1, F.concat("url", F.lit("(1/2) "))).when(n % 4 == 2, F.col("url")).otherwise(F.concat("url", F.lit(" ("), n % 7 + 1, F.lit("/"), n % 3 + 1, F.lit(")")))
    return table(spark, d, "pages").select("page_id", tx.title_part(title).alias("p")).select("page_id", "p.title", "p.continues")


_JOINED = r"regexp_replace(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), '/$', '')"


@query(f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN {_JOINED} || '/a/b?c=1' WHEN 1 THEN 'https://other.org/x' WHEN 2 THEN {_JOINED} || '/base/next.html' ELSE {_JOINED} || '/up' END AS link FROM pages")
def t27_resolved_links(spark, d):
    """Links against their page's address: from the root, whole, beside the page, and upwards."""
    n = F.col("page_id")
    href = F.when(n % 4 == 0, "/a/b?c=1").when(n % 4 == 1, "https://other.org/x").when(n % 4 == 2, "next.html").otherwise("../up")
    base = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1), F.lit("/base/page.html"))
    rows = table(spark, d, "pages").select("page_id", base.alias("url"), F.concat(F.lit("<a href='"), href, F.lit("'>x</a>")).alias("html"))
    return tree.with_tree(rows).select("page_id", tree.first(tree.find(F.col("tree.nodes"), "a"))["link"].alias("link"))


_PRESETS = """
WITH p(genre, kinds, attributes, relations) AS (VALUES
 ('fantasy', 'character,house,kingdom,location,magic_system', 'title:character,allegiance:character,status:character', 'member_of,ally,enemy,mentor,family,located_in'),
 ('litrpg', 'character,skill,item,quest,guild', 'level:character,class:character,stats:character', 'member_of,ally,enemy,mentor,family,located_in'),
 ('mystery', 'character,suspect,clue,location,organization', 'suspicion:suspect,alibi:suspect,status:character', 'member_of,ally,enemy,family,located_in'),
 ('romance', 'character,family,location,organization', 'relationship_status:character,occupation:character', 'family,ally,enemy,located_in'),
 ('xianxia', 'character,sect,realm,technique,artifact,beast', 'rank:character,status:character,affiliation:character,state:sect', 'member_of,ally,enemy,mentor,family,located_in')),
c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'litrpg' WHEN 'BUILDING' THEN 'fantasy' WHEN 'FURNITURE' THEN 'mystery' WHEN 'HOUSEHOLD' THEN 'romance' WHEN 'MACHINERY' THEN 'xianxia' END AS genre, c_nationkey % 6 = 0 AS odd FROM customer)
SELECT c_custkey, coalesce(kinds, 'character,group,location,item') AS kinds, coalesce(attributes, 'status:character,role:character') AS attributes, coalesce(relations, 'member_of,ally,enemy,located_in') AS relations FROM c LEFT JOIN p ON p.genre = c.genre AND NOT odd
"""


@query(_PRESETS)
def l09_customer_presets(spark, d):
    """All kinds, attributes and relations of each customer's genre, which goes by the segment; some have none that is known."""
    genres = F.create_map(*(F.lit(x) for pair in {"AUTOMOBILE": "litrpg", "BUILDING": "fantasy", "FURNITURE": "mystery", "HOUSEHOLD": "romance", "MACHINERY": "xianxia"}.items() for x in pair))
    genre = F.when(F.col("c_nationkey") % 6 == 0, F.when(F.col("c_nationkey") == 0, "western")).otherwise(F.try_element_at(genres, F.col("c_mktsegment")))
    rows = table(spark, d, "customer").select("c_custkey", sites.ontology(genre).alias("o"))
    return rows.select("c_custkey", F.array_join("o.kinds", ",").alias("kinds"), F.array_join(F.transform("o.attributes", lambda a: F.concat_ws(":", a["name"], a["kind"])), ",").alias("attributes"), F.array_join("o.relations", ",").alias("relations"))


@query()
def e13_alignment_payloads(spark, d):
    """The longer words of each document as names, its text as display and as source."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}{6,}"), F.lit(0)))
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("source"), F.col("text").alias("display"), names.alias("names"))
    return alignment.alignment_payloads(rows).select("doc_id", F.size("payloads").alias("n_payloads"), F.size(F.flatten(F.transform("payloads", lambda p: p["display_names"]))).alias("n_names"))
