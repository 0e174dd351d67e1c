"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its equal segments. Two fingerprints differ in at least as many
bits as their embeddings are apart in Manhattan distance. So fingerprints within 2 bits have embeddings within 2 steps,
and then share a grid point at most one step from each: every fingerprint is put into its own grid cell and those one
step away, cells are joined, and pairs are verified by counting differing bits.

Cells with many fingerprints are refined: their members are embedded anew with segments of one bit. A cell then is a
bit pattern with at most 65 members, all within 2 bits of each other, so linking each to the smallest loses nothing.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import partitions, saved, scratch
from quirefold.llm.components import connected_components
from quirefold.llm.shingle_join import similar_links

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Cells with more fingerprints than this are refined.
DENSE = 48


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles: a bit is 1 if it is set in over half of the shingles' XXH64."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(x.as_py() or b"", shingle) for x in batch["text"].cast(pa.binary())], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(marks.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row; a text without words has 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, fp long")


def _placed(fps: DataFrame, bits: int, segment: int) -> DataFrame:
    """fp and cell: for each fingerprint the grid points at most one step from its embedding, as packed bit counts."""
    fp, width = F.col("fp"), {1: 1, 4: 3}[segment]
    step = F.explode(F.expr(f"concat(array(0L), transform(sequence(0, {bits // segment - 1}), i -> shiftleft(1L, i * {width})))"))
    if segment == 1:  # a pattern of bits is its own embedding
        return fps.select("fp", step.alias("step")).select("fp", fp.bitwiseXOR(F.col("step")).alias("cell"))
    own = F.lit(0).cast("long")
    for i in range(bits // segment):
        own = own.bitwiseOR(F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, i * segment).bitwiseAND(F.lit((1 << segment) - 1))).cast("long"), i * width))
    if bits < 64:
        own = own.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, bits), bits // segment * width))  # a tag above the fingerprint
    both = fps.select("fp", own.alias("own")).select("fp", "own", step.alias("step")).select("fp", "own", "step", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"))
    return both.where("step != 0 or sign = 1").select("fp", (F.col("own") + F.col("sign") * F.col("step")).alias("cell"))


def near_pairs(fps: DataFrame, bits: int = 64, dense: int = DENSE) -> DataFrame:
    """(a, b): pairs of the distinct fps (column fp, long) whose components are those of all pairs within 2 bits.

    Every returned pair is within 2 bits. Pairs of sparse cells are all there; dense cells give one pair a member.
    """
    spark = fps.sparkSession
    placed = _placed(fps.select("fp"), bits, 4).repartition(partitions(spark), "cell")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    members = saved(placed.join(sizes, "cell"), "members")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    few = members.where(F.col("n") <= dense)
    some = few.select("cell", F.col("fp").alias("a")).join(few.select("cell", F.col("fp").alias("b")), "cell").where((F.col("a") < F.col("b")) & close).select("a", "b")
    many = members.where(F.col("n") > dense).select("fp").distinct()
    exact = _placed(many, bits, 1)
    stars = exact.groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("all")).where(F.size("all") > 1)  # at most bits + 1 members
    stars = stars.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, bits + 1)).alias("b")).where(close)
    return some.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id, text; others are ignored).

    Fingerprints link at 2 or fewer differing bits; component_id is the smallest doc_id that links reach. A null or empty
    text, or one without words, has fingerprint zero, which links like any other. A row without doc_id gets the component
    of its fingerprint, null if no row of the component has a doc_id.
    """
    found = saved(fingerprints(docs, shingle), "fingerprints")
    distinct = saved(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    parts = connected_components(near_pairs(distinct.select("fp")))
    joined = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    joined = saved(joined, "joined")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = saved(joined.select("fp", "component").join(saved(least, "least"), "component").select("fp", "component_id"), "ids")
    return found.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _row(text: str = "text") -> Column:
    """A hash of the text as it is, which with the doc_id names a row."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _marked(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(x.as_py() or b"", shingle) for x in batch["text"].cast(pa.binary())], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "row", "k1", "k2")), pa.array(marks.view(np.int64))], ["doc_id", "row", "k1", "k2", "fp"])


def _simhash_links(marks: DataFrame) -> DataFrame:
    """(a, b): links of classes (class, fp) whose components are those of all pairs of fingerprints within 2 bits."""
    with scratch(marks.sparkSession, "close"):
        firsts = saved(marks.groupBy("fp").agg(F.min("class").alias("rep")), "firsts")
        same = marks.join(firsts, "fp").where("class != rep").select(F.col("rep").alias("a"), F.col("class").alias("b"))
        ends = near_pairs(firsts.select("fp")).withColumnRenamed("b", "_b").join(firsts.select(F.col("fp").alias("a"), F.col("rep").alias("_ra")), "a")
        across = ends.join(firsts.select(F.col("fp").alias("_b"), F.col("rep").alias("_rb")), "_b").select(F.col("_ra").alias("a"), F.col("_rb").alias("b"))
        return saved(same.unionByName(across), "close")


def _classes(docs: DataFrame, shingle: int, similarity: float, marks: int = 0) -> tuple[DataFrame, DataFrame]:
    """doc_id, k1 and k2 of every row; and the classes of the same words: k1, k2, least (doc_id and row of one that stands
    for the class, the smallest) and first (the smallest of all classes that links reach).

    marks: words of the shingles of SimHash, whose links come before those of similarity; 0 for none.
    """
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    low = F.translate(F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    with scratch(docs.sparkSession, "keyed", "classes", "parts"):
        keyed = docs.select(doc_id, _row().alias("row"), F.xxhash64(low).alias("k1"), F.xxhash64(low, F.lit(1)).alias("k2"), *([F.col("text").cast("string").alias("text")] if marks else []))
        if marks:
            keyed = keyed.mapInArrow(partial(_marked, shingle=marks), "doc_id long, row long, k1 long, k2 long, fp long")
        keyed = saved(keyed, "keyed")
        # by row first: how often each comes
        own = ["fp"] if marks else []  # texts of the same words have the same fingerprint
        counted = keyed.groupBy("doc_id", "row", "k1", "k2", *own).agg(F.count("*").alias("n"))
        classes = counted.groupBy("k1", "k2").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row", "n"))).alias("least"), *(F.min(c).alias(c) for c in own))
        classes = saved(classes.withColumn("class", F.monotonically_increasing_id()), "classes")  # numbered once, by being written
        close = [_simhash_links(classes.select("class", "fp"))] if marks else []
        named = classes.where("least is not null").select("class", "least.doc_id", "least.row", "least.n")
        # texts are read twice rather than written: once for the index of shingles, once for the sets of candidates
        single = docs.select(doc_id, "text", _row().alias("row")).join(named, ["doc_id", "row"])
        # only rows that come again need to be brought together
        single = single.where("n = 1").unionByName(single.where("n > 1").dropDuplicates(["doc_id", "row"]))
        single = single.select(F.col("class").alias("doc_id"), "text")
        links = similar_links(single, shingle, similarity)
        for more in close:
            links = links.unionByName(more)
        parts = saved(connected_components(links), "parts")
    joined = classes.join(parts.select(F.col("node").alias("class"), "component"), "class", "left")
    joined = saved(joined.select("k1", "k2", "least", F.coalesce("component", "class").alias("component")), "joined")
    first = saved(joined.groupBy("component").agg(F.min("least").alias("first")), "first")
    return keyed, saved(joined.join(first, "component").select("k1", "k2", "least", "first"), "named")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id of every row: near-duplicates whose sets of word shingles have a Jaccard similarity of
    `similarity` or more are linked.

    SimHash would lose pairs of that similarity, so the links come from shingle_join, which loses none. Rows of the same
    words are one class from the start; texts without words are one class. Rows that share a doc_id but not their words
    are documents of their own; a row without doc_id gets the smallest of its group, or null.
    """
    with scratch(docs.sparkSession, "keyed", "named"):
        keyed, named = _classes(docs, shingle, similarity)
    return keyed.join(named, ["k1", "k2"]).select("doc_id", F.col("first.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the smallest doc_id, of several such rows the one
    whose text has the smallest hash, of equal texts the one of the smallest columns. Rows without doc_id all stay.

    Fingerprints of three-word shingles link at 2 or fewer differing bits, as in simhash_components; what they lose of the
    pairs that reach `similarity` near_duplicates' links add.
    """
    own = docs.where("doc_id is not null")
    with scratch(docs.sparkSession, "stay"):
        named = _classes(own, shingle, similarity, 3)[1]
        stay = saved(named.select("first.*").distinct().select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("n").alias("_n")), "stay")
    kept = own.withColumn("_row", _row()).withColumn("_id", F.col("doc_id").cast("long")).join(stay, ["_id", "_row"])
    again = kept.where("_n > 1").groupBy("_id", "_row").agg(F.min(F.struct(*docs.columns)).alias("s")).select("s.*")
    kept = kept.where("_n = 1").select(*docs.columns).unionByName(again)
    return kept.unionByName(docs.where("doc_id is null"))
