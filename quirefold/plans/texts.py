"""Queries of glossaries, answers, keys and pages of facts, with the SQL they are checked against."""

from pyspark.sql import functions as F

from quirefold.functions import answers, glossary, keys, udtf
from quirefold.functions import text as tx
from quirefold.operators import ask, chunks, glossaries, pagemodels
from quirefold.plans.domain import table
from quirefold.plans.registry import query
from quirefold.sources import sites


def _structs(fields: tuple[str, ...], rows) -> F.Column:
    return F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(fields, r, strict=True))) for r in rows))


TERMS = (("an", "<i>", "term"), ("and", "an & on", "term"), ("", "x", "term"), ("zz", " ", "term"))


def _of_novels(novels, fields: tuple[str, ...], rows):
    """The same rows for every novel, as a table."""
    return novels.select("novel_id").distinct().select("novel_id", F.inline(_structs(fields, rows)))


def _novels(spark, d):
    return table(spark, d, "documents").withColumnRenamed("source", "novel_id")


def _turns(spark, d):
    return table(spark, d, "conversations").withColumn("novel_id", F.concat(F.lit("n"), F.col("conv_id") % 7))


_FIELDS = ("source", "target", "kind")


@query("SELECT doc_id, sha256(replace(replace(replace(text, 'and', 'a' || chr(1)), 'an', '<i>'), 'a' || chr(1), 'an & on')) AS primed FROM documents")
def t07_t11_primed(spark, d):
    """One pass, longest first: what was put in is not looked at again."""
    docs = _novels(spark, d)
    return glossaries.prime(docs.select("novel_id", "doc_id", "text"), _of_novels(docs, _FIELDS, TERMS)).select("doc_id", F.sha2("primed", 256).alias("primed"))


def novel_terms(spark, d):
    """A glossary for every novel: its words of over five letters, with their target in capitals."""
    words = _novels(spark, d).select("novel_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}{6,}"), F.lit(0)))).alias("source"))
    words = words.groupBy("novel_id", "source").count().where("count > 0")  # the counts keep the optimizer from shuffling targets with words
    return words.select("novel_id", "source", F.concat(F.lit("«"), F.upper("source"), F.lit("»")).alias("target"), F.lit("term").alias("kind"))


@query()
def t07_novel_glossaries(spark, d):
    """Thousands of terms a novel, each in its own novel only; words within words go to the longest."""
    return glossaries.prime(_novels(spark, d).select("novel_id", "doc_id", "text"), novel_terms(spark, d)).select("doc_id", F.sha2("primed", 256).alias("primed"))


_TAG = """'<locked-term data-id="t{}">{}</locked-term>'"""


@query(f"SELECT doc_id, sha256(replace(replace(replace(text, 'and', 'a' || chr(1)), 'an', {_TAG.format(1, '&lt;i&gt;')}), 'a' || chr(1), {_TAG.format(0, 'an &amp; on')})) AS tagged, sha256(replace(replace(replace(text, 'and', 'a' || chr(1)), 'an', '<i>'), 'a' || chr(1), 'an & on')) AS plain FROM documents")
def t13_protected(spark, d):
    docs = _novels(spark, d)
    tagged = glossaries.protect(docs.select("novel_id", "doc_id", "text"), _of_novels(docs, _FIELDS, TERMS))
    return tagged.select("doc_id", F.sha2("protected", 256).alias("tagged"), F.sha2(glossary.unprotected(F.col("protected")), 256).alias("plain"))


@query(
    "WITH t AS (SELECT doc_id, text, replace(text, 'on', 'un') AS said FROM documents) SELECT doc_id, trim(said) = '' AS empty, contains(text, 'and') AND NOT contains(said, 'also') AS misses, contains(text, 'or') AND contains(said, 'or') AS keeps, "
    "(contains(text, 'and') AND NOT contains(said, 'also')) OR (contains(text, 'and') AND contains(said, 'and')) AS hard FROM t"
)
def t14_constraints(spark, d):
    docs = _novels(spark, d)
    terms = _of_novels(docs, _FIELDS, (("and", "also", "character_name"), ("or", "o", "term")))
    rows = glossaries.check(docs.select("novel_id", "doc_id", "text", F.replace("text", F.lit("on"), F.lit("un")).alias("translated")), terms).select("doc_id", F.col("violations").alias("c"))
    return rows.select("doc_id", "c.empty", F.array_contains("c.missing", "also").alias("misses"), F.array_contains("c.untranslated", "or").alias("keeps"), "c.hard")


#: Terms are turns' words in their case, targets their capitals; a term counts where it stands anywhere in the text.
_VIOLATIONS = r"""
WITH t AS (SELECT 'n' || (conv_id % 7) AS novel_id, conv_id, turn, text, replace(text, 'e', 'E') AS said FROM conversations),
w AS (SELECT DISTINCT novel_id, unnest(regexp_extract_all(text, '[a-z]{9,}')) AS source FROM t WHERE turn % 2 = 0),
h AS (SELECT t.conv_id, t.turn, count(*) FILTER (WHERE NOT contains(said, upper(source))) AS n_missing, count(*) FILTER (WHERE contains(said, source)) AS n_untranslated FROM t JOIN w ON t.novel_id = w.novel_id AND contains(t.text, source) GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(n_missing, 0) AS n_missing, coalesce(n_untranslated, 0) AS n_untranslated FROM t LEFT JOIN h USING (conv_id, turn)
"""


@query(_VIOLATIONS)
def t14_novel_constraints(spark, d):
    turns = _turns(spark, d)
    words = turns.where("turn % 2 = 0").select("novel_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]{9,}"), F.lit(0))).alias("source")).distinct()
    terms = words.select("novel_id", "source", F.upper("source").alias("target"), F.lit("term").alias("kind"))
    found = glossaries.check(turns.select("novel_id", "conv_id", "turn", "text", F.replace("text", F.lit("e"), F.lit("E")).alias("translated")), terms)
    return found.select("conv_id", "turn", F.size("violations.missing").cast("long").alias("n_missing"), F.size("violations.untranslated").cast("long").alias("n_untranslated"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'queue' WHEN o_custkey % 3 = 0 THEN 'retranslate' WHEN o_custkey % 3 = 1 THEN 'none' ELSE 'respell' END AS action FROM orders")
def t12_respell_action(spark, d):
    primed = F.when(F.col("o_custkey") % 3 == 1, "new").when(F.col("o_custkey") % 3 == 2, "old")
    return table(spark, d, "orders").select("o_orderkey", glossary.respell_action(F.col("o_orderstatus") == "F", primed, F.lit("new")).alias("action"))


@query()
def t10_respelled(spark, d):
    """Names of one word respelled, where no longer name holds them."""
    docs = _novels(spark, d)
    spellings = _of_novels(docs, ("source", "target"), (("and", "und"), ("and the", None)))
    return glossaries.respell(docs.select("novel_id", "doc_id", "text", "lang"), spellings).select("doc_id", F.sha2("respelled", 256).alias("text"))


@query()
def t08_marked(spark, d):
    """Turns of conversations with names as markers."""
    turns = _turns(spark, d).select("novel_id", "conv_id", "turn", "text")
    marked = glossaries.mark(turns, _of_novels(turns, ("key", "spelling"), (("1", "the"), ("2", "of the"), ("3", "a"))))
    return marked.select("conv_id", "turn", "marked.text", F.array_join("marked.order", ",").alias("order"))


_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+')"
_NAMED = rf"""
WITH t AS (SELECT 'n' || (conv_id % 7) AS novel_id, conv_id, turn, {_TOKENS} AS tokens FROM conversations),
w AS (SELECT novel_id, conv_id, turn, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM t),
n AS (SELECT DISTINCT novel_id, token FROM w WHERE turn % 2 = 0 AND regexp_full_match(token, '\p{{L}}{{5,}}')),
m AS (SELECT w.*, n.token IS NOT NULL AS hit FROM w LEFT JOIN n USING (novel_id, token))
"""


def _turn_names(turns):
    """Names of each novel: the words of over four letters in its even turns."""
    words = turns.where("turn % 2 = 0").select("novel_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_-])\p{L}{5,}(?![\p{L}\p{N}_-])"), F.lit(0))).alias("spelling")).distinct()
    return words.select("novel_id", F.concat(F.lit("k"), F.left(F.md5("spelling"), F.lit(8))).alias("key"), "spelling")


@query(_NAMED + "SELECT t.conv_id, t.turn, coalesce(string_agg(CASE WHEN hit THEN '⟦k' || substr(md5(token), 1, 8) || '⟧' ELSE token END, '' ORDER BY i), '') AS text FROM t LEFT JOIN m USING (conv_id, turn) GROUP BY 1, 2")
def t08_marked_names(spark, d):
    """Thousands of names a novel, from a table."""
    turns = _turns(spark, d).select("novel_id", "conv_id", "turn", "text")
    return glossaries.mark(turns, _turn_names(turns)).select("conv_id", "turn", "marked.text")


@query(_NAMED + "SELECT t.conv_id, t.turn, coalesce(string_agg(DISTINCT 'k' || substr(md5(token), 1, 8), ',' ORDER BY 'k' || substr(md5(token), 1, 8)) FILTER (WHERE hit), '') AS named FROM t LEFT JOIN m USING (conv_id, turn) GROUP BY 1, 2")
def t47_named_names(spark, d):
    turns = _turns(spark, d).select("novel_id", "conv_id", "turn", "text")
    return glossaries.name(turns, _turn_names(turns)).select("conv_id", "turn", F.array_join(F.sort_array("named"), ",").alias("named"))


@query()
def t47_named_in(spark, d):
    turns = _turns(spark, d).select("novel_id", "conv_id", "turn", "text")
    named = glossaries.name(turns, _of_novels(turns, ("key", "spelling"), (("1", "the"), ("2", "of the"), ("3", "a"))))
    return named.select("conv_id", "turn", F.array_join("named", ",").alias("named"))


@query()
def e17_l04_replayed(spark, d):
    """Spans laid over turns: some overlap, some leave the text, some show their target."""
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(s).alias("status"), F.lit(t).alias("target")) for a, b, s, t in ((5, 9, "locked", "NEW"), (7, 12, "locked", "x"), (12, 15, "pending", "y"), (0, 2, "locked", ""), (30, 31, "locked", "longer"), (4, 4, "locked", "z"))))
    return table(spark, d, "conversations").select("conv_id", "turn", glossary.replayed(F.col("text"), spans).alias("r")).select("conv_id", "turn", "r.text", F.size("r.spans").alias("n_spans"))


@query("SELECT doc_id, sha256(translate(text, chr(160) || chr(8239) || chr(8199) || chr(8201) || chr(8208) || chr(8209), '    --')) AS plain FROM (SELECT doc_id, replace(text, ' a', chr(8201) || 'a' || chr(8209)) AS text FROM documents)")
def t15_lint(spark, d):
    said = F.replace("text", F.lit(" a"), F.lit(" a‑"))
    return table(spark, d, "documents").select("doc_id", F.sha2(tx.lint(said), 256).alias("plain"))


@query("SELECT doc_id, CASE lang WHEN 'zh' THEN 'zh-Hans' ELSE 'zh' END IN ('zh', 'zh-Hans') AND doc_id % 5 <> 0 AND length(regexp_replace(text, '[^\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]', '', 'g')) > 30 AS untranslated FROM documents")
def t16_untranslated(spark, d):
    source, target = F.when(F.col("lang") == "zh", "zh-Hans").otherwise("zh"), F.when(F.col("doc_id") % 5 == 0, "zh-Hant").otherwise("en-GB")
    return table(spark, d, "documents").select("doc_id", tx.untranslated(F.col("text"), source, target).alias("untranslated"))


#: A duration and its seconds.
DURATIONS = (("2m3.5s", 123.5), ("2 min 3 sec", 123.0), ("7", 7.0), (" 7.5 ", 7.5), ("1e2", 100.0), ("-3", 0.0), ("7 seconds", 7.0), ("750ms", None), ("2h", None), ("2m", None), ("", None), (None, None), ("1minutes 1s", 61.0))
#: A message and the limit, use and request of tokens that it names.
QUOTAS = (
    ("tokens per day (TPD): Limit 100,000, Used 99,500, Requested 1200", 100000, 99500, 1200), ("requests: limit 5", None, None, None), ("TPM limit=6000 limit: 7000", 7000, None, None), ("token used 12345678901234", None, None, None), (None, None, None, None),
)
_sql = lambda values: "[" + ", ".join("NULL" if v is None else f"{v!r}e0" if isinstance(v, float) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v) for v in values) + f"][event_id % {len(values)} + 1]"
_at = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))


@query(f"SELECT event_id, {_sql([x[1] for x in DURATIONS])} AS seconds FROM events")
def t43_durations(spark, d):
    return table(spark, d, "events").select("event_id", tx.duration_seconds(_at([x[0] for x in DURATIONS])).alias("seconds"))


@query("SELECT event_id, " + ", ".join(f"{_sql([x[i] for x in QUOTAS])} AS {n}_tokens" for i, n in ((1, "limit"), (2, "used"), (3, "requested"))) + " FROM events")
def t44_token_quota(spark, d):
    return table(spark, d, "events").select("event_id", answers.token_quota(_at([x[0] for x in QUOTAS])).alias("q")).select("event_id", "q.*")


#: A page's citations and how they read once tidied.
CITED = (("x (ch4, ch5) y", "x (ch. 4, 5) y"), ("(ch. 3-4)", "(ch. 3–4)"), ("(ch 1; ch. 2 – 3, 7)", "(ch. 1, 2–3, 7)"), ("(chapter 4)", "(chapter 4)"), ("", ""))


@query(f"SELECT event_id, {_sql([x[1] for x in CITED])} AS tidy FROM events")
def t45_tidy_citations(spark, d):
    return table(spark, d, "events").select("event_id", answers.tidy_citations(_at([x[0] for x in CITED])).alias("tidy"))


#: An answer and its labels, invalid, future and malformed citations, a:1 and b:9 being allowed and the gate 5.
AUDITED = (("see [chunk:a ch:1] and [chunk:b ch:9]", 2, 0, 1, 0), ("[chunk:a ch:2] [chunk:a ch:x]", 1, 1, 0, 1), ("none", 0, 0, 0, 0), ("[chunk: ch:1][chunk:c ch:99]", 1, 1, 1, 1))


@query("SELECT event_id, " + ", ".join(f"{_sql([x[i] for x in AUDITED])} AS {n}" for i, n in enumerate(("", "labels", "invalid", "future", "malformed")) if i) + " FROM events")
def t20_citations(spark, d):
    return table(spark, d, "events").select("event_id", answers.audit_citations(_at([x[0] for x in AUDITED]), F.array(F.lit("a:1"), F.lit("b:9")), 5).alias("a")).select("event_id", "a.*")


#: An answer of a model; the categories, kinds and texts of its facts; whether it says none; its names.
TAGGED = (
    ("## Facts\nintro | draft\n## Facts\n- intro | A is x\n2. relationship: Friend | A is B's friend\nrelationship | no kind\nevent: k | kind\nodd | y\n## Names\n* place | Town\nperson | P", "intro::A is x;relationship:friend:A is B's friend", False, "place:Town"),
    ("## facts\n\nNone\n", "", True, ""), ("think\n## Draft\nx\n## Answer\nItem | A | b ", "item::A | b", False, ""), ("status|  ok  ", "status::ok", False, ""), ("", "", False, ""),
)


@query("SELECT event_id, " + ", ".join(f"{_sql([x[i] for x in TAGGED])} AS {n}" for i, n in enumerate(("", "facts", "none", "names")) if i) + " FROM events")
def t19_tagged(spark, d):
    answer = _at([x[0] for x in TAGGED])
    told = F.array_join(F.transform(answers.parse_tagged(answer), lambda r: F.concat(r["category"], F.lit(":"), F.coalesce(r["kind"], F.lit("")), F.lit(":"), r["text"])), ";")
    names = F.array_join(F.transform(answers.parse_names(answer), lambda r: F.concat_ws(":", r["kind"], r["name"])), ";")
    return table(spark, d, "events").select("event_id", told.alias("facts"), answers.says_none(answer).alias("none"), names.alias("names"))


#: An answer in fields between bars, its facts and what could not be read.
FIELDS = (("think | a | b\n## x\n- Event | Happened | A; B;; | did | it\n\nbad | line\n* plot|odd||f", "event:happened:A+B:did | it:true;plot:odd::f:false", "bad | line"), ("a|b|c|", "", "a|b|c|"), ("", "", ""))


@query(f"SELECT event_id, {_sql([x[1] for x in FIELDS])} AS facts, {_sql([x[2] for x in FIELDS])} AS unparsed FROM events")
def t21_fields(spark, d):
    rows = table(spark, d, "events").select("event_id", answers.parse_fields(_at([x[0] for x in FIELDS])).alias("p"))
    told = F.transform("p.facts", lambda f: F.concat(f["category"], F.lit(":"), f["status"], F.lit(":"), F.array_join(f["names"], "+"), F.lit(":"), f["fact"], F.lit(":"), f["known_status"].cast("string")))
    return rows.select("event_id", F.array_join(told, ";").alias("facts"), F.array_join("p.unparsed", ";").alias("unparsed"))


@query("SELECT conv_id, turn, contains(lower(text), 'the') AND contains(lower(text), 'a') AND turn = 1 AS supported FROM conversations")
def t46_supported_alias(spark, d):
    fact = F.array(F.struct(F.col("turn").alias("chapter"), F.col("text").alias("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", answers.supported_alias(F.lit("The"), F.lit("A"), F.lit(1), fact).alias("supported"))


@query()
def t31_evidence(spark, d):
    at = F.locate("1", F.col("text")) - 1
    return table(spark, d, "documents").where(at >= 0).select("doc_id", glossary.evidence(F.col("text"), at, at + 1).alias("evidence"))


@query()
def t06_translation_parts(spark, d):
    parts = chunks.translation_parts(table(spark, d, "documents").select("doc_id", "text", "lang"), 100)
    return parts.select("doc_id", "part", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha"))


@query("""SELECT doc_id, sha256('["translation-input-v4","' || lang || '","' || source || '"]') AS fingerprint, left(sha256('gemini' || chr(31) || 'https://api.site.org/v1' || chr(31) || source), 32) AS credential FROM documents""")
def t36_t41_fingerprints(spark, d):
    return table(spark, d, "documents").select("doc_id", keys.fingerprint(F.lit("translation-input-v4"), F.col("lang"), F.col("source")).alias("fingerprint"), keys.credential_fingerprint(F.lit("gemini"), F.lit("HTTPS://Api.Site.org/v1/"), F.col("source")).alias("credential"))


@query()
def t37_t38_stable_ids(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", keys.stable_id(F.col("role"), F.col("text")).alias("id"), F.sha2(keys.json_string(F.concat("text", F.lit('é\U0001f600"\\\n\x01')), True), 256).alias("json"))


@query("SELECT event_id, event_type || ':' || (user_id % 3) = 'view:1' AS kept FROM events")
def t40_j17_cacheable(spark, d):
    return table(spark, d, "events").select("event_id", keys.cacheable(F.lit("view:1"), F.col("event_type"), (F.col("user_id") % 3).cast("string")).alias("kept"))


_KINDS = "CASE turn % 6 WHEN 0 THEN 'subordinate' WHEN 1 THEN 'mother' WHEN 2 THEN 'rival' WHEN 3 THEN 'friend' WHEN 4 THEN 'enemy' END"
_CATEGORIES = "['intro', 'alias', 'relationship', 'ability', 'item', 'affiliation', 'status', 'place', 'event'][CAST((conv_id + turn) % 9 AS INT) + 1]"
_ABOUT = f"about AS (SELECT conv_id, ordinal, category, kind, a, b FROM (SELECT conv_id, CAST(turn AS INT) AS ordinal, {_CATEGORIES} AS category, {_KINDS} AS kind, 's' || (length(text) % 5) AS a, 's' || (turn % 4) AS b FROM conversations))"


def _about(spark, d):
    category = F.element_at(F.array(*map(F.lit, ("intro", "alias", "relationship", "ability", "item", "affiliation", "status", "place", "event"))), ((F.col("conv_id") + F.col("turn")) % 9 + 1).cast("int"))
    subjects = F.array(F.concat(F.lit("s"), F.length("text") % 5), F.concat(F.lit("s"), F.col("turn") % 4))
    return table(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("ordinal"), category.alias("category"), F.expr(_KINDS).alias("kind"), subjects.alias("subjects"))


_READ = "CASE WHEN kind IS NULL OR a = b THEN NULL WHEN b = 's1' THEN kind WHEN a = 's1' AND kind = 'subordinate' THEN 'superior' WHEN a = 's1' AND kind IN ('friend', 'enemy') THEN kind END"


@query(f"WITH {_ABOUT} SELECT conv_id, ordinal, CASE WHEN r IS NULL THEN NULL WHEN b = 's1' THEN a ELSE b END AS other, r AS kind FROM (SELECT *, {_READ} AS r FROM about WHERE a = 's1' OR b = 's1')")
def l02_other_is(spark, d):
    rows = _about(spark, d).where(F.array_contains("subjects", "s1"))
    return rows.select("conv_id", "ordinal", pagemodels.other_is("s1").alias("o")).select("conv_id", "ordinal", "o.other", "o.kind")


@query(
    f"WITH {_ABOUT} SELECT conv_id, ordinal, CASE WHEN category IN ('event', 'place') THEN 'history' WHEN category <> 'relationship' AND a <> 's1' THEN 'mentions' WHEN category IN ('intro', 'alias') THEN category "
    "WHEN category = 'relationship' THEN CASE r WHEN 'subordinate' THEN 'Subordinates' WHEN 'superior' THEN 'Superiors' WHEN 'mother' THEN 'Family' WHEN 'friend' THEN 'Friends' WHEN 'enemy' THEN 'Enemies' ELSE 'more' END "
    f"ELSE CASE category WHEN 'ability' THEN 'Abilities' WHEN 'item' THEN 'Possessions' WHEN 'affiliation' THEN 'Affiliations' ELSE 'Status' END END AS part FROM (SELECT *, {_READ} AS r FROM about WHERE a = 's1' OR b = 's1')"
)
def l01_wiki_page(spark, d):
    """Where each fact that names a character stands on the character's page."""
    return pagemodels.wiki_parts(_about(spark, d), "s1").select("conv_id", "ordinal", "part")


@query(f"WITH {_ABOUT} SELECT conv_id, ordinal, CASE WHEN category = 'event' OR (a <> 's1' AND category <> 'affiliation') THEN 'history' WHEN a <> 's1' THEN 'Members' WHEN category = 'intro' THEN 'intro' WHEN category = 'alias' THEN 'alias' ELSE 'details' END AS part FROM about WHERE a = 's1' OR b = 's1'")
def l03_subject_page(spark, d):
    return pagemodels.subject_parts(_about(spark, d), "s1", "organization").select("conv_id", "ordinal", "part")


@query("SELECT event_id, ['foreign_person', 'personal_title', 'semantic_term', 'chinese_person', 'place_name', 'chinese_person'][event_id % 6 + 1] AS role FROM events")
def l08_candidate_role(spark, d):
    method = _at(["restored_name", "translated_title", "semantic_translation", "pinyin", "other", None])
    return table(spark, d, "events").select("event_id", pagemodels.role_of(method, F.when(F.col("event_id") % 6 == 4, "place_name")).alias("role"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0")
def b07_review_passed(spark, d):
    """A second filter that is always added to the first: held knowledge is never read."""
    rows = table(spark, d, "orders").where("o_custkey % 2 = 0").withColumn("review_state", F.when(F.col("o_orderstatus") == "F", "passed").otherwise("held"))
    return pagemodels.reviewed(rows).select("o_orderkey")


@query("SELECT 'both' AS which, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT 'only', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def g07_intersect_except(spark, d):
    done, open_ = (table(spark, d, "orders").where(F.col("o_orderstatus") == s).select("o_custkey") for s in "FO")
    n = lambda df, which: df.agg(F.count("*").alias("n")).select(F.lit(which).alias("which"), "n")
    return n(done.intersect(open_), "both").unionByName(n(done.subtract(open_), "only"))


@query()
def d29_mention_ranking(spark, d):
    """How many turns name each of some names, longer names that hold them not counted."""
    people = spark.createDataFrame([(x,) for x in ("the", "of the", "a", "in a")], "name string")
    return pagemodels.mention_ranking(table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("fact_id"), "text"), people)


@query("SELECT event_id, CAST(max(s - 3600 * n) OVER (PARTITION BY user_id ORDER BY s, event_id) + 3600 * n AS BIGINT) AS due FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events)")
def j13_host_pacing(spark, d):
    """When each request may start, an hour after the one before to its host."""
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("host"), F.unix_timestamp("ts").cast("long").alias("ts"))
    return pagemodels.paced(rows, 3600).select("event_id", F.col("due").cast("long").alias("due"))


@query("SELECT source AS novel, count(*) AS n FROM conversations c JOIN documents ON conv_id = doc_id WHERE contains(c.text, 'the') GROUP BY 1")
def h06_affected_chapters(spark, d):
    """Chapters that a confirmed term touches, and what is to be done for each novel's."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.col("source").alias("novel"))
    rows = table(spark, d, "conversations").join(docs, "conv_id").where(F.contains("text", F.lit("the")))
    return rows.groupBy("novel").agg(F.count("*").alias("n"))


@query("SELECT event_id, [6, 5, 5, 5, 4, 4, 4][event_id % 7 + 1] AS n_kinds, ['located_in', 'located_in', 'located_in', 'located_in', 'located_in', 'located_in', 'located_in'][event_id % 7 + 1] AS last FROM events")
def l09_ontology(spark, d):
    genre = _at(["xianxia", "fantasy", "mystery", "litrpg", "romance", "", None])
    return table(spark, d, "events").select("event_id", sites.ontology(genre).alias("o")).select("event_id", F.size("o.kinds").alias("n_kinds"), F.element_at("o.relations", -1).alias("last"))


@query("SELECT doc_id, CAST(pos AS INT) AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM (SELECT doc_id, '温馨提示: ' || replace(text, chr(10), chr(10) || '本章完 ') AS text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 2 = 1)) WHERE doc_id % 2 = 1 AND NOT regexp_matches(line, '^\\s*$')")
def t29_without_boilerplate(spark, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("温馨提示: "), F.replace("text", F.lit("\n"), F.lit("\n本章完 ")))).otherwise(F.col("text"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.where(~sites.is_boilerplate(F.col("line"))).select("doc_id", "pos")


@query()
def t24_t25_densest_block(spark, d):
    """The lines of each page's densest block."""
    return sites.densest_block(table(spark, d, "pages"), 20).select("page_id", F.size("lines").alias("n_lines"))


@query()
def a06_a09_site_pages(spark, d):
    """Pages as their sites' readers see them; the given ones are wrapped as those sites write them."""
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://www.site"), F.col("page_id") % 4, F.lit(".org/book/"), F.col("page_id")).alias("url"), "html")
    body = F.regexp_replace("html", "(?s)^.*<body[^>]*>|</body>.*$", "")
    n = F.col("page_id") % 4
    wrap = lambda before, after: F.concat(F.lit(before), body, F.lit(after))
    page = F.when(n == 0, wrap("<div id='article'><h4>T</h4>", "</div><a id='next_url' href='n'>x</a>")).when(n == 1, wrap("<h1 class='headline'>T</h1><div class='a content'>", "</div><a href='/p2'>下一页</a><a href='/c2'>下一章</a>"))
    page = page.otherwise(wrap("<div id='chapterWarp'><div class='chapter-content'><h1>T (1/2)</h1><div class='content'>", "</div></div></div><div class='foot-nav'><a href='n'>下一章</a></div>"))
    return sites.read_pages(rows.withColumn("html", page), {"site0.org": "article", "site1.org": "content", "site2.org": "wrapped"}).select("page_id", "title", "next_url", "continues", F.length("text").alias("chars"))


@query()
def k_chunk_text(spark, d):
    """The table function chunk_text over documents, in SQL."""
    udtf.register(spark)
    return spark.sql("SELECT d.doc_id, c.ordinal, c.start, c.end FROM {docs} d, LATERAL chunk_text(d.text, d.lang, 400) c", docs=table(spark, d, "documents"))


#: Names are the words of over four letters of a novel's even turns; a text's own words are compared with them.
_MENTIONS = _NAMED + "SELECT novel_id, conv_id AS doc_id, count(*) AS n FROM m WHERE hit GROUP BY 1, 2"


@query(_MENTIONS)
def k_scan_mentions(spark, d):
    """The table function scan_mentions with a partition for each novel, in SQL: whole words only, hyphens being letters."""
    udtf.register(spark)
    turns = _turns(spark, d)
    sql = """SELECT novel_id, doc_id, count(*) AS n FROM scan_mentions(TABLE(
      SELECT novel_id, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS STRING) AS text, CAST(NULL AS STRING) AS lang, key AS alias_id, spelling AS surface FROM {names}
      UNION ALL SELECT novel_id, conv_id, replace(text, '-', '_'), 'en', NULL, NULL FROM {turns}) PARTITION BY novel_id ORDER BY text IS NOT NULL) GROUP BY 1, 2"""
    return spark.sql(sql, names=_turn_names(turns), turns=turns)


@query(
    "WITH e AS (SELECT vec_id, vec_id // 3 AS at, 'n' || (vec_id % 3) AS novel_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
    "s AS (SELECT q.vec_id AS question_id, c.vec_id AS id, list_cosine_distance(q.v, c.v) AS distance FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.novel_id = c.novel_id AND c.at <= q.at AND q.label = c.label) "
    "SELECT CAST(question_id AS VARCHAR) AS question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(distance, 12), id) AS INT) AS rank, id, round(distance, 6) AS distance FROM s QUALIFY rank <= 8"
)
def f02_many_questions(spark, d):
    """Every twentieth vector asks in its own novel, up to its own chapter, in its own space."""
    rows = _vectors(spark, d)
    return ask.nearest_for_all(rows.where("id % 20 = 0").withColumn("question_id", F.col("id")).withColumn("at", F.col("chapter_index")), rows).select("question_id", "rank", "id", F.round("distance", 6).alias("distance"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.concat(F.lit("n"), F.col("vec_id") % 3).alias("novel_id"), F.floor(F.col("vec_id") / 3).cast("int").alias("chapter_index"), F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("embedding_space"))


@query(
    "WITH RECURSIVE e AS (SELECT vec_id, vec_id // 3 AS at, 'n' || (vec_id % 3) AS novel_id, CAST(embedding AS DOUBLE[]) AS v, text FROM embeddings JOIN documents ON doc_id = vec_id), "
    "s AS (SELECT q.vec_id AS question_id, c.vec_id AS id, c.at AS chapter, c.text, list_cosine_distance(q.v, c.v) AS distance FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.novel_id = c.novel_id AND c.at < q.at), "
    "i AS (SELECT question_id, id, '[chunk:' || id || ' ch:' || chapter || ']' || chr(10) || text || chr(10) AS part, row_number() OVER (PARTITION BY question_id ORDER BY round(distance, 12), id) AS rank FROM s QUALIFY rank <= 8), "
    "p AS (SELECT question_id, rank, id, part, CASE WHEN length(part) <= 8000 THEN length(part) ELSE 0 END AS used, length(part) <= 8000 AS fits FROM i WHERE rank = 1 "
    "UNION ALL SELECT i.question_id, i.rank, i.id, i.part, p.used + CASE WHEN p.used + length(i.part) <= 8000 THEN length(i.part) ELSE 0 END, p.used + length(i.part) <= 8000 FROM p JOIN i ON i.question_id = p.question_id AND i.rank = p.rank + 1), "
    "t AS (SELECT question_id, string_agg(part, chr(10) ORDER BY rank) FILTER (WHERE fits) AS context, string_agg(id, ',' ORDER BY rank) FILTER (WHERE fits) AS sources FROM p GROUP BY 1) "
    "SELECT CAST(vec_id AS VARCHAR) AS question_id, sha256(coalesce(context, '')) AS context, coalesce(sources, '') AS sources, coalesce(sources, '') = '' AS insufficient FROM e LEFT JOIN t ON question_id = vec_id WHERE vec_id % 20 = 0"
)
def l10_ask(spark, d):
    """Every twentieth vector asks; documents are the chunks. The first chapters see nothing before them."""
    rows = _vectors(spark, d).drop("embedding_space").withColumn("embedding_space", F.lit(None).cast("string")).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    asked = rows.where("id % 20 = 0").withColumn("question_id", F.col("id")).withColumn("at", F.col("chapter_index") - 1)
    return ask.ask(asked, rows, 8, 8000).select("question_id", F.sha2("context", 256).alias("context"), F.array_join(F.transform("sources", lambda x: x["id"].cast("string")), ",").alias("sources"), (F.col("answer") == ask.INSUFFICIENT).alias("insufficient")).na.fill(False, ["insufficient"])
