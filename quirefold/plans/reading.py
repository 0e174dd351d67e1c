"""Queries of the views that readers get, with the SQL they are checked against."""

from pyspark.sql import functions as F

from quirefold.operators import views
from quirefold.plans.domain import chapters, facts, retractions, with_
from quirefold.plans.registry import query

_L05 = with_("chapters") + r""",
c AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '«' || text ELSE text END AS body FROM chapters),
v AS (SELECT *, chapter_index AS upto FROM c WHERE (doc_id % 7 <> 0 OR doc_id % 14 = 0) AND doc_id % 5 <> 4),
s AS (SELECT v.*, k, CASE WHEN k = 1 THEN doc_id % 5 WHEN k = 3 AND doc_id % 2 = 1 THEN doc_id % 7 END AS j, CASE WHEN 7 * k + 5 <= length(body) THEN regexp_replace(lower(substr(body, CAST(7 * k + 1 AS BIGINT), 5)), '[^\p{L}\p{N}]', '', 'g') ELSE '' END AS key FROM v, range(4) t(k) WHERE 7 * k + 5 <= length(body) + 3),
x AS (SELECT *, j IS NOT NULL AND j <> 4 AND 3 * j <= upto AS locked, j IS NOT NULL AND 2 * j <= upto AND j % 2 = 0 AS pending, key <> '' AND key = regexp_replace(lower(substr(body, 15, 5)), '[^\p{L}\p{N}]', '', 'g') AS spelled FROM s),
y AS (SELECT *, CASE WHEN locked THEN 'locked:T' || j WHEN pending THEN 'pending:C' || j WHEN j IS NOT NULL THEN 'unlocked:' WHEN spelled THEN 'pending:' || substr(body, 15, 5) || '!' ELSE '-:' END AS shown FROM x),
g AS (SELECT doc_id, string_agg((10 * doc_id + k) || ':' || shown, '|' ORDER BY k) AS spans FROM y GROUP BY 1)
SELECT 'r' || (doc_id % 3) AS reader_id, novel_id, chapter_index, sha256(body) AS text, coalesce(spans, '') AS spans, EXISTS (SELECT 1 FROM c n WHERE n.novel_id = v.novel_id AND n.chapter_index = v.chapter_index + 1) AS has_next FROM v LEFT JOIN g USING (doc_id)
"""


@query(_L05)
def l05_chapter_views(spark, d):
    """Every chapter is asked for by a reader, some of whom have not come so far. Terms are those of the chapter's number, and
    one of its own whose offered spelling is a part of the text."""
    docs = chapters(spark, d).withColumn("chapter_index", F.col("chapter_index").cast("int"))
    n, at = F.col("doc_id"), ["novel_id", "chapter_index"]
    done = F.when(n % 7 == 0, "pending").otherwise("done")
    body = F.when(n % 3 == 0, F.concat(F.lit("«"), F.col("text"))).otherwise(F.col("text"))
    all_ = docs.select(*at, "doc_id", done.alias("status"), (n % 14 == 0).alias("translation_ready"), F.col("text").alias("raw_text"), F.when(n % 3 == 0, body).alias("translated_text"), body.alias("body"))
    asked = all_.select(F.concat(F.lit("r"), n % 3).alias("reader_id"), *at, (F.col("chapter_index") - (n % 5 == 4).cast("int")).alias("at"))
    places = all_.select(*at, "doc_id", F.length("body").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).where("7 * k + 5 <= n + 3")
    spans = places.select(*at, (10 * n + F.col("k")).alias("mention_id"), (7 * F.col("k")).alias("char_start"), (7 * F.col("k") + 5).alias("char_end"))
    term = F.when(F.col("k") == 1, n % 5).when((F.col("k") == 3) & (n % 2 == 1), n % 7)
    occurrences = places.select(*at, F.concat(F.lit("t"), term).alias("source_term"), (7 * F.col("k")).alias("char_start"), (7 * F.col("k") + 5).alias("char_end")).where("source_term is not null")
    named = all_.select(*at, F.explode(F.array(F.concat(F.lit("t"), n % 5), F.concat(F.lit("u"), n))).alias("source_term"))
    j = F.col("j")
    numbers = all_.select("novel_id").distinct().select("novel_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("j"))
    glossary = numbers.select("novel_id", F.concat(F.lit("t"), j).alias("source_term"), F.concat(F.lit("T"), j).alias("target_term"), F.lit("character_name").alias("constraint_class"), (3 * j).alias("locked_at_chapter"), (j == 4).alias("deleted"))
    offered = lambda x: F.array(F.struct(x.alias("target_term")))
    reviews = numbers.select("novel_id", F.concat(F.lit("t"), j).alias("source_term"), F.when(j % 2 == 0, "pending").otherwise("confirmed").alias("status"), F.lit("place").alias("term_role"), offered(F.concat(F.lit("C"), j)).alias("candidates"), (2 * j).alias("first_seen_chapter"))
    own = all_.select("novel_id", F.concat(F.lit("u"), n).alias("source_term"), F.lit("pending").alias("status"), F.lit("place").alias("term_role"), offered(F.concat(F.substring("body", 15, 5), F.lit("!"))).alias("candidates"), F.col("chapter_index").alias("first_seen_chapter"))
    seen = views.chapter_views(asked, all_.drop("body"), spans, occurrences, named, glossary, reviews.unionByName(own))
    told = F.transform("spans", lambda s: F.concat(s["mention_id"], F.lit(":"), F.coalesce(s["rendering"]["status"], F.lit("-")), F.lit(":"), F.coalesce(s["rendering"]["target_term"], F.lit(""))))
    return seen.select("reader_id", *at, F.sha2("text", 256).alias("text"), F.array_join(told, "|").alias("spans"), "has_next")


_WIKI = with_("facts", "retractions") + """,
t AS (SELECT * EXCLUDE (text, category), text || ' ⟦' || subjects[1] || '⟧ met ⟦x⟧' AS text, subjects[1] AS marker, CASE WHEN ordinal % 3 = 0 THEN 'event' WHEN ordinal % 7 <> 6 THEN category END AS category FROM facts),
w AS (SELECT novel_id, chapter_index, max(prompt_version) AS prompt_version FROM t WHERE category IS NOT NULL GROUP BY 1, 2),
k AS (SELECT t.* FROM t JOIN w USING (novel_id, chapter_index, prompt_version) WHERE category IS NOT NULL AND NOT EXISTS (SELECT 1 FROM retractions r WHERE r.novel_id = t.novel_id AND r.chapter_index = t.chapter_index AND r.prompt_version = t.prompt_version AND r.ordinal = t.ordinal)),
n AS (SELECT p || s AS subject, p || s || v AS name, 5 * v + s % 4 AS since FROM (VALUES ('s'), ('t')) a(p), range(13) b(s), range(2) c(v) WHERE s <> 5),
q AS (SELECT 'r' || m AS reader_id, novel_id, m AS upto FROM (SELECT DISTINCT novel_id FROM facts), (VALUES (3), (12), (500)) b(m)),
"""


def _wiki(spark, d):
    """Facts with a marker each and one of nobody, readers of every novel at three chapters, and names that change."""
    found = facts(spark, d).withColumn("text", F.concat("text", F.lit(" ⟦"), F.element_at("subjects", 1), F.lit("⟧ met ⟦x⟧")))
    found = found.withColumn("category", F.when(F.col("ordinal") % 3 == 0, "event").when(F.col("ordinal") % 7 != 6, F.col("category"))).drop("conv_id")
    novels = found.select("novel_id").distinct()
    asked = novels.select(F.explode(F.array(*map(F.lit, (3, 12, 500)))).alias("at"), "novel_id").select(F.concat(F.lit("r"), "at").alias("reader_id"), "novel_id", "at")
    s, v = F.col("s"), F.col("v")
    names = novels.select("novel_id", F.explode(F.array(F.lit("s"), F.lit("t"))).alias("p")).select("*", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("s")).where("s <> 5").select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("v"))
    names = names.select("novel_id", F.concat("p", s).alias("subject"), F.concat("p", s, v).alias("name"), F.lit("character").alias("kind"), (5 * v + s % 4).alias("since"))
    return found, retractions(spark, d), asked, names


def _told(rows, *more):
    known = F.array_sort(F.transform(F.map_entries("names"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["name"])))
    return rows.select("reader_id", "novel_id", *more, "chapter_index", "ordinal", F.sha2("text", 256).alias("text"), F.array_join(known, ",").alias("names"))


_SHOWN = "sha256(replace(replace(text, '⟦x⟧', 'someone'), '⟦' || marker || '⟧', coalesce(shown, 'someone'))) AS text, array_to_string(known, ',') AS names"
_SQL = (
    _WIKI
    + "z AS (SELECT subject, m AS upto, arg_max(name, since) AS name FROM n, (VALUES (3), (12), (500)) b(m) WHERE since <= m GROUP BY 1, 2), "
    + "e AS (SELECT q.reader_id, q.upto, k.* FROM q JOIN k ON q.novel_id = k.novel_id AND k.chapter_index <= q.upto), "
    + "h AS (SELECT DISTINCT reader_id, upto, novel_id, chapter_index, ordinal, unnest(subjects) AS subject FROM e), "
    + "l AS (SELECT reader_id, novel_id, chapter_index, ordinal, list_sort(list(subject || '=' || z.name)) AS known FROM h JOIN z USING (subject, upto) GROUP BY 1, 2, 3, 4), "
    + "f AS (SELECT e.*, z.name AS shown, coalesce(known, []) AS known FROM e LEFT JOIN z ON z.subject = e.marker AND z.upto = e.upto LEFT JOIN l USING (reader_id, novel_id, chapter_index, ordinal)) "
)


@query(_SQL + f"SELECT reader_id, novel_id, chapter_index, ordinal, {_SHOWN} FROM f WHERE category = 'event'")
def l06_timeline(spark, d):
    found, gone, asked, names = _wiki(spark, d)
    return _told(views.timeline(asked, found, gone, names))


@query(_SQL + f"SELECT reader_id, novel_id, subject, chapter_index, ordinal, {_SHOWN} FROM f JOIN (VALUES ('s3'), ('s5'), ('t2')) b(subject) ON list_contains(subjects, subject) WHERE EXISTS (SELECT 1 FROM z WHERE z.subject = b.subject AND z.upto = f.upto)")
def l06_page_facts(spark, d):
    """Three subjects, one of which nobody knows by name."""
    found, gone, asked, names = _wiki(spark, d)
    pages = asked.select("*", F.explode(F.array(*map(F.lit, ("s3", "s5", "t2")))).alias("subject"))
    return _told(views.page_facts(pages, found, gone, names), "subject")
