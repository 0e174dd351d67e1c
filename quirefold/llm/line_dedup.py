"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are duplicates if at most one character is inserted, deleted or replaced between them. Every line emits, as
hashed keys, itself and all its variants with one character deleted; lines that share a key are joined, the edit distance
is verified, and the earliest line stays.

Most lines have no partner, so variants are made only where one is possible. Both lines of a pair agree on their first
or their last half: lines whose half no other line has are left out. Then, cut into segments, they agree on all before
and all after the segment with the edit: only the segments for which another line agrees on both are expanded. A key is
a hash of what stands before the segment, the shortened segment, and what stands after. Both tests lose no pair.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.llm.common import saved

_SEGMENT = 64
_RUN = 256
#: Up to so many rows of ids are sent to all tasks; beyond, the join shuffles.
_BROADCAST_ROWS = 400_000


def _lines(docs: DataFrame) -> DataFrame:
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))
    return found.where(F.col("doc_id").isNotNull() & F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.hash(line).alias("k2")]


def _halves(line: Column) -> Column:
    """Keys that lines within one edit share one of: the first and last half of the shorter one's length."""
    n = F.length(line)
    sizes = F.array(n, n - 1)
    return F.flatten(F.transform(sizes, lambda m: F.array(F.xxhash64(F.lit(0), m, F.left(line, F.floor(m / 2).cast("int"))), F.xxhash64(F.lit(1), m, F.right(line, F.floor(m / 2).cast("int"))))))


def _chain(parts: str, last: str) -> str:
    """SQL of running hashes of an array of strings: for each place the hash of all before it, from the end that `last`
    names (before: from the front; after: from the back). Empty parts change nothing. The hashes are put together in runs,
    since an append copies its array.
    """
    at = "i" if last == "before" else f"size({parts}) - 1 - i"
    step = f"(a, i) -> array_append(a, if(get({parts}, {at}) = '', element_at(a, -1), xxhash64(element_at(a, -1), get({parts}, {at}))))"
    run = f"aggregate(sequence(b * {_RUN}, least((b + 1) * {_RUN}, size({parts})) - 1), array(if(b = 0, 0L, element_at(element_at(r, -1), -1))), {step})"
    found = f"aggregate(sequence(0, cast((size({parts}) - 1) div {_RUN} AS int)), cast(array() AS array<array<bigint>>), (r, b) -> array_append(r, {run}), r -> flatten(transform(r, (x, k) -> slice(x, 1, size(x) - 1))))"
    return found if last == "before" else f"reverse({found})"


def _within_one(a: str, b: str) -> Column:
    """Whether at most one character is inserted, deleted or replaced. Long lines are compared from their first difference
    on, which halving finds, since the edit distance of long strings costs the square of their length.
    """
    middle = "cast((s.lo + s.hi + 1) div 2 AS int)"
    step = f"if(left({a}, {middle}) = left({b}, {middle}), named_struct('lo', {middle}, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {middle} - 1))"
    same = f"aggregate(sequence(0, 31), named_struct('lo', 0, 'hi', least(length({a}), length({b}))), (s, i) -> if(s.lo < s.hi, {step}, s), s -> s.lo)"
    more = f"length({a}) - length({b})"
    ends = f"substring({a}, {same} + if({more} >= 0, 2, 1)) = substring({b}, {same} + if({more} <= 0, 2, 1))"
    return F.expr(f"CASE WHEN abs({more}) > 1 THEN false WHEN length({a}) <= 512 THEN levenshtein({a}, {b}, 1) BETWEEN 0 AND 1 ELSE {ends} END")


def _segments(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each line's segments: whole ones, and ones a character short, as the line has them if it is the shorter of a pair.

    before and after are hashes of all that stands in front of and behind a segment, made in one go along the line.
    """
    own = lines.select("k1", "doc_id", "line_no", "line")
    # a line of one segment has nothing before or after it, so it has no frame; one that just fills it is a long line too
    alone = own.where(F.length("line") <= _SEGMENT).select("k1", "doc_id", "line_no", F.lit(0).alias("j"), F.lit(0).alias("short"), F.col("line").alias("segment"), F.lit(None).cast("long").alias("frame"))
    cut = lambda x: F.regexp_extract_all(x, F.lit(f"(?s).{{1,{_SEGMENT}}}"), F.lit(0))
    long_ = own.where(F.length("line") >= _SEGMENT)
    # where segments are full to the end, an empty one follows, which a longer line's last one becomes
    full = F.concat(cut(F.col("line")), F.when(F.length("line") % _SEGMENT == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    behind = F.concat(F.array(F.left("line", F.lit(_SEGMENT - 1))), cut(F.substring("line", _SEGMENT, F.length("line"))))  # the same, cut one character earlier
    long_ = long_.select("k1", "doc_id", "line_no", full.alias("full"), behind.alias("behind"))
    chains = long_.select("*", F.expr(_chain("full", "before")).alias("before"), F.expr(_chain("full", "after")).alias("after0"), F.expr(_chain("behind", "after")).alias("after1"))
    told = chains.select("k1", "doc_id", "line_no", F.posexplode(F.arrays_zip("full", "before", "after0", "after1")).alias("j", "x"))
    whole = told.select("k1", "doc_id", "line_no", "j", F.lit(0).alias("short"), F.col("x.full").alias("segment"), F.xxhash64("j", "x.before", "x.after0").alias("frame")).where("segment is not null")
    short = told.select("k1", "doc_id", "line_no", "j", F.lit(1).alias("short"), F.left("x.full", F.lit(_SEGMENT - 1)).alias("segment"), F.xxhash64("j", "x.before", "x.after1").alias("frame")).where("segment is not null")
    return alone, whole.unionByName(short)


def near_lines(lines: DataFrame) -> DataFrame:
    """k1, doc_id, line_no, p_doc, p_line: for each distinct line the earliest earlier one within one edit.

    lines: distinct lines by k1, each at its earliest place (doc_id, line_no), with its text in line.
    """
    alone, segments = _segments(lines)
    frames = saved(segments.groupBy("frame").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo != hi").select("frame"), "frames")
    shared = saved(segments.join(frames, "frame").select(alone.columns).unionByName(alone), "segments")
    place = F.struct("doc_id", "line_no")
    cut = shared.where("short = 0 and segment != ''").withColumn("i", F.explode(F.sequence(F.lit(0), F.length("segment") - 1)))
    cut = cut.select("k1", place.alias("at"), F.col("i"), F.xxhash64("frame", F.concat(F.left("segment", F.col("i")), F.substring("segment", F.col("i") + 2, F.lit(_SEGMENT)))).alias("key"))
    # a line as such meets the longer lines that become it; its last segment is short either way
    whole = shared.where(f"short = 1 or length(segment) < {_SEGMENT}").select("k1", place.alias("at"), F.lit(-1).alias("i"), F.xxhash64("frame", "segment").alias("key")).distinct()
    same, alike = W.partitionBy("key"), W.partitionBy("key", "i")
    met = cut.unionByName(whole).withColumn("as_such", F.min(F.when(F.col("i") < 0, F.col("at"))).over(same)).withColumn("longer", F.min(F.when(F.col("i") >= 0, F.col("at"))).over(same)).withColumn("replaced", F.min("at").over(alike))
    partner = F.when(F.col("i") < 0, F.col("longer")).otherwise(F.least("as_such", "replaced"))
    best = met.select("k1", "at", partner.alias("p")).where("p < at").groupBy("k1", "at").agg(F.min("p").alias("p"))
    best = saved(best.select("k1", "at.doc_id", "at.line_no", F.col("p.doc_id").alias("p_doc"), F.col("p.line_no").alias("p_line")), "partners")
    own = lines.select("k1", F.col("line").alias("a"))
    other = lines.select(F.col("doc_id").alias("p_doc"), F.col("line_no").alias("p_line"), F.col("line").alias("b"))
    return best.join(own, "k1").join(other, ["p_doc", "p_line"]).where(_within_one("a", "b")).select("k1", "doc_id", "line_no", "p_doc", "p_line")


def line_dedup(docs: DataFrame, min_chars: int = 16) -> DataFrame:
    """docs with removed (numbers of the lines taken out, from 0) and the text without them.

    A line goes if an earlier line, by doc_id and then by its number, is equal or, both having `min_chars` characters or
    more, within one edit. Lines are judged on the input, cut at \\n, and compared as they are. Blank lines are never
    counted as duplicates. All columns are kept; removed is replaced if it was there. A null text stays null, an empty one
    empty; a text that loses all its lines becomes empty. Rows that share a doc_id share their lines' places: equal lines
    at one place do not remove each other, and a line removed from one is removed from all. A row without doc_id keeps all.
    """
    lines = _lines(docs)
    occurring = lines.select("doc_id", "line_no", *_keys(F.col("line")))
    long_ = lines.where(F.length("line") >= min_chars)
    halves = long_.select(F.xxhash64("line").alias("k1"), F.explode(_halves(F.col("line"))).alias("half"))
    met = halves.groupBy("half").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo != hi").select("half")
    placed = long_.select("doc_id", "line_no", F.explode(_halves(F.col("line"))).alias("half"))
    flagged = saved(placed.join(met, "half").select("doc_id", "line_no").distinct(), "flagged")
    if flagged.count() <= _BROADCAST_ROWS:
        flagged = F.broadcast(flagged)
    chosen = long_.join(flagged, ["doc_id", "line_no"], "left_semi").groupBy(*_keys(F.col("line"))).agg(F.min(F.struct("doc_id", "line_no", "line")).alias("s"))
    chosen = saved(chosen.select("k1", "k2", "s.*"), "chosen")
    near = near_lines(chosen).join(chosen.select("k1", "k2"), "k1").select("k1", "k2", F.struct(F.col("p_doc").alias("doc_id"), F.col("p_line").alias("line_no")).alias("at"))
    equal = occurring.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = saved(equal.unionByName(near).groupBy("k1", "k2").agg(F.min("at").alias("at")), "first")
    gone = occurring.join(first, ["k1", "k2"]).where(F.struct("doc_id", "line_no") > F.col("at"))
    gone = gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed")).withColumnRenamed("doc_id", "_id")
    out = docs.drop("removed").join(gone, F.col("doc_id").cast("long") == F.col("_id"), "left").drop("_id")
    # what stands between the lines that go, each stretch once: linear in the lines, however many go
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("removed", k - 1) + 1)
    stretches = lambda lines: F.transform(F.sequence(F.lit(0), F.size("removed")), lambda k: F.slice(lines, begin(k) + 1, F.coalesce(F.get("removed", k), F.size(lines)) - begin(k)))
    kept = F.flatten(F.get(F.transform(F.array(F.split(F.col("text").cast("string"), "\n")), stretches), F.lit(0)))
    return out.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
