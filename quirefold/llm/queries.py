"""The registered queries of the training-data operators, and the SQL they are checked against."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import divergence, license_scan, line_dedup, mixing, periodic_runs, pii, quality, sentencepiece_codec, simhash_dedup, substring_dedup, topk, warc
from quirefold.llm.common import WORD, saved, shared_dir, table
from quirefold.llm.embedding_dedup import embedding_dedup

#: Where the model file of public pieces lies, unless the caller names another.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def model_bytes(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"), F.sha2("text", 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    told = mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round(F.get("positions", F.lit(0)), 6).alias("position"))
    return told.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.train(spark))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    every = F.concat("base", "added")
    return found.select("doc_id", *counts, F.size(every).cast("long").alias("n_spans"), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(every).alias("spans"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))).alias("path"))
    return license_scan.license_scan(docs).select("doc_id", "path", "license", F.round("score", 6).alias("score"), "is_license_file", "inherited", "effective")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, docs = model_bytes(), table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentencepiece_codec.encode(docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)), model)
    decoded = sentencepiece_codec.decode(encoded.withColumn("pieces", F.col("ids")), model)
    return decoded.select("doc_id", F.size("pieces").cast("long").alias("n_tokens"), F.col("pieces").alias("ids"), (F.sha2("text", 256) == F.col("sha")).alias("round_trip"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~quality.held_out("doc_id")))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/quirefold-warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    found = warc.captures(saved(warc.read_archive(spark, path).drop("payload"), "records"))
    page = lambda metadata: warc.field(F.flatten(F.transform(metadata, lambda m: m["headers"])), "page-id").cast("long")
    whole = lambda name: F.coalesce(F.col(f"refers_to.{name}"), F.col(f"response.{name}"))
    return found.select(page(F.col("metadata")).alias("page_id"), whole("payload_bytes").alias("payload_bytes"), whole("payload_sha256").alias("payload_digest"), F.col("type").alias("record_type"), page(F.col("refers_to.metadata")).alias("refers_to"))


def with_periods(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which every tenth document, by crc32 of its id, repeats some of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10))).withColumn("_w", F.when(F.col("_g").isNotNull(), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))))
    docs = docs.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    docs = docs.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    rest = F.col("_n") - F.col("_a")
    again = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(again, F.lit(1), rest)), " ")
    return docs.select("doc_id", F.when(F.col("_a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # runs are by start, then period, so only a greater length/period replaces
    greater = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda best, x: F.when(greater(best, x), x).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_exact_top_k, op3_line_dedup, op4_mixing, op5_pii, op6_license_scan, op7_sentencepiece, op8_simhash, op9_embedding_dedup, op10_quality, op11_divergence, op12_warc, op13_periodic_runs)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_WINDOW = " || ' ' || ".join(f"lead(word, {i}) OVER o" for i in range(13))

_OP1 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
s AS (SELECT doc_id, pos AS i, {_WINDOW} AS same FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY same) AS first FROM s WHERE same IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM m WHERE first < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_SOUND = "len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"

_OP2 = f"""
WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings WHERE {_SOUND}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""

_OP3 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
seen AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT line, min((doc_id, line_no)) AS place, length(line) AS n FROM seen GROUP BY line),
c AS (SELECT a.line AS a, b.line AS b FROM f a JOIN f b ON left(a.line, 7) = left(b.line, 7) WHERE a.n >= 16 AND b.n >= 16 AND abs(a.n - b.n) <= 1 AND b.place < a.place
  UNION SELECT a.line, b.line FROM f a JOIN f b ON right(a.line, 7) = right(b.line, 7) WHERE a.n >= 16 AND b.n >= 16 AND abs(a.n - b.n) <= 1 AND b.place < a.place),
p AS (SELECT a, b, length(a) - length(b) AS more, coalesce(list_position([z[1] = z[2] FOR z IN list_zip(string_split(a, ''), string_split(b, ''))], false) - 1, least(length(a), length(b))) AS same FROM c),
near AS (SELECT DISTINCT a AS line FROM p WHERE substr(a, CAST(same + CASE WHEN more >= 0 THEN 2 ELSE 1 END AS BIGINT)) = substr(b, CAST(same + CASE WHEN more <= 0 THEN 2 ELSE 1 END AS BIGINT))),
gone AS (SELECT doc_id, line_no FROM seen JOIN f USING (line) WHERE ((doc_id, line_no) > place) OR line IN (SELECT line FROM near)),
r AS (SELECT doc_id, count(*) AS n, string_agg(line_no, ',' ORDER BY line_no) AS removed FROM gone GROUP BY 1),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM l ANTI JOIN gone USING (doc_id, line_no) GROUP BY 1)
SELECT d.doc_id, coalesce(r.n, 0) AS n_removed, coalesce(r.removed, '') AS removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_OP4 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, substr(md5('0:' || doc_id), 1, 15) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS which FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][which + 1] :: DOUBLE AS weight, 3.0 :: DOUBLE * source_size AS most FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS FIRST)),
t AS (SELECT source, source_size, which, least(most, coalesce((SELECT arg_min(level, most / weight) FROM l WHERE level <= most / weight), 'inf' :: DOUBLE) * weight) AS target FROM l),
r AS (SELECT doc_id, size, source_size, target, which, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN source_size > 0 THEN least(greatest(ceil((target - start) / source_size), 0), 3) ELSE 1 END AS copies, CASE WHEN target > 0 THEN start / target ELSE 0 END AS f FROM r),
p AS (SELECT *, [8.0, 1.0, 0.5][which + 1] :: DOUBLE AS w0, [-6.0, 2.0, 1.0][which + 1] :: DOUBLE AS slope, f * [5.0, 2.0, 1.0][which + 1] :: DOUBLE AS due FROM c)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS INT) AS copies,
  CASE WHEN copies > 0 THEN round(least(2 * due / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * due, 0))), 1), 6) END AS position
FROM p
"""

_OP9 = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {_SOUND} AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT vec_id, b FROM reach JOIN l ON other = a),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
x AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS every FROM x GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(every) AS HUGEINT) AS lang_total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM x JOIN k USING (lang, term) GROUP BY 1, 2, 3),
t AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY 1, 2),
s AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000 :: HUGEINT * (coalesce(n, 0) + 5) // (coalesce(total, 0) + 5 * v) AS p, 1 + 1000000000 :: HUGEINT * (every + 5) // (lang_total + 5 * v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON a.lang = f.lang AND a.source = f.source AND b.source = f.item
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r QUALIFY part = 'pair' OR rank <= 50
"""

_OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN n < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""

#: CRC-32 of a number's digits: each byte goes in, then eight steps of one bit.
_CRC = "xor(list_reduce([4294967295] || [ascii(c) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')], lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, (s & 1) * 3988292384))), 4294967295)"

_OP13 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w, {_CRC} AS h FROM documents),
e AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM d),
m AS (SELECT *, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM e),
o AS (SELECT doc_id, n, w, a, p, unnest(range(n)) AS i FROM m),
words AS MATERIALIZED (SELECT doc_id, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM o),
q AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
k AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM q),
s AS (SELECT doc_id, min(i) AS start, count(*) + p AS length, p FROM k GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(24, 3 * p)),
r AS (SELECT doc_id, start, length, min(p) AS period FROM s GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS nth FROM r),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM r GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN b ON d.doc_id = b.doc_id AND nth = 1
"""

#: The others need a trained model, XXH64 or a segmentation, which SQL lacks; brute force tests them.
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op2_exact_top_k": _OP2, "op3_line_dedup": _OP3, "op4_mixing": _OP4, "op9_embedding_dedup": _OP9, "op11_divergence": _OP11, "op12_warc": _OP12, "op13_periodic_runs": _OP13}
