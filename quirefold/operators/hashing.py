"""Content hashes, near-duplicate marks, and tamper-evident logs."""

import hashlib
import json
import math
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Characters of texts that are worked on together, and shingles whose hashes a task remembers.
_CHARS, _KNOWN = 1 << 19, 1 << 20


class Shingles:
    """Hashes of shingles, the first 8 bytes of their SHA-256, remembered within a task.

    A shingle is a number whose digits are those of its characters, which are numbered as they come.
    """

    def __init__(self, size: int = 5, most: int = _KNOWN):
        self.size, self.most = size, most
        self.base = math.floor((2**63 - 1) ** (1 / size) * (1 - 1e-12))
        self.forget()

    def forget(self) -> None:
        self.digit, self.points = np.full(sys.maxunicode + 1, -1, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        self.keys, self.known = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

    def marks(self, shingles: list[str]) -> np.ndarray:
        digests = b"".join([hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest()[:8] for x in shingles])
        return np.frombuffer(digests, dtype=np.uint64)

    def numbered(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each distinct shingle first stands, and for each place the number of its shingle, for any number of
        characters: where they are too many for 64 bits, pairs of numbers are numbered anew."""
        digit = np.unique(points, return_inverse=True)[1].astype(np.int64)
        base, n = int(digit.max()) + 1, len(points) - self.size + 1
        key, width = np.zeros(n, dtype=np.int64), 1
        for k in range(self.size):
            if width * base >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
                width = n
            key, width = key * base + digit[k : k + n], width * base
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        return first, number

    def placed(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """The marks of the distinct shingles of a text, and for each of its places the number of its shingle there."""
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        new = np.unique(points[self.digit[points] < 0])
        if len(self.keys) > self.most or len(self.points) + len(new) > self.base:
            self.forget()
            new = np.unique(points)
        if len(new) > self.base:
            first, number = self.numbered(points)
            return self.marks([joined[a : a + self.size] for a in first.tolist()]), number
        self.digit[new] = np.arange(len(self.points), len(self.points) + len(new))
        self.points = np.concatenate([self.points, new])
        digit, n = self.digit[points], len(points) - self.size + 1
        key = digit[:n].copy()
        for k in range(1, self.size):
            key *= self.base
            key += digit[k : k + n]
        coded = pa.array(key).dictionary_encode()
        own, number = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        order = np.argsort(own)  # in order they are found faster
        own, at = own[order], np.searchsorted(self.keys, own[order])
        missing = own if not len(self.keys) else own[self.keys[np.minimum(at, len(self.keys) - 1)] != own]
        if len(missing):
            each = self.points[missing[:, None] // np.power(self.base, np.arange(self.size)[::-1]) % self.base]
            text = each.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            found = self.marks([text[a : a + self.size] for a in range(0, len(text), self.size)])
            to = np.searchsorted(self.keys, missing)
            self.keys, self.known = np.insert(self.keys, to, missing), np.insert(self.known, to, found)
            at = np.searchsorted(self.keys, own)
        marks = np.empty(len(own), dtype=np.uint64)
        marks[order] = self.known[at]
        return marks, number

    def simhashes(self, texts: list[str]) -> list[int]:
        """For each text the votes of all its shingles of `size` characters, in lower case with single spaces; a bit is set if
        it is in over half of them. A shorter text, the empty one too, is one shingle."""
        plain = [" ".join(unicodedata.normalize("NFKC", x).lower().split()) for x in texts]
        out = [0] * len(texts)
        short = [i for i, x in enumerate(plain) if len(x) <= self.size]
        for i, mark in zip(short, self.marks([plain[i] for i in short]).tolist(), strict=True):
            out[i] = int.from_bytes(mark.to_bytes(8, sys.byteorder), "big")
        long, at = [i for i, x in enumerate(plain) if len(x) > self.size], 0
        while at < len(long):
            upto, total = at, 0
            while upto < len(long) and (upto == at or total + len(plain[long[upto]]) <= _CHARS):
                total += len(plain[long[upto]])
                upto += 1
            own = [plain[i] for i in long[at:upto]]
            sizes = np.array([len(x) for x in own])
            votes, n = self.votes("".join(own), sizes), sizes - self.size + 1
            packed = np.packbits(2 * votes > n[:, None], axis=1)
            for i, bits in zip(long[at:upto], packed, strict=True):
                out[i] = int.from_bytes(bits.tobytes(), "big")
            at = upto
        return out

    def votes(self, joined: str, sizes: np.ndarray) -> np.ndarray:
        """For each of the texts joined, of these sizes, in how many of its shingles each of the 64 bits is set."""
        marks, number = self.placed(joined)
        ends = np.cumsum(sizes)
        begins, places = ends - sizes, sizes - self.size + 1
        # up to 255 places of one text are added as bytes, eight bits of the mark in a word; what stands over two texts is
        # the last part of the text before and is left out
        parts = -(-places // 255)
        first = np.cumsum(parts + 1) - (parts + 1)
        starts = np.repeat(begins - 255 * first, parts + 1) + 255 * np.arange(int((parts + 1).sum()))
        starts[first + parts] = begins + places
        starts = starts[:-1]  # after the last text nothing stands
        lanes = np.unpackbits(marks.view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
        sums = np.empty((len(starts), 8), dtype=np.uint64)
        for k in range(8):
            sums[:, k] = np.add.reduceat(np.ascontiguousarray(lanes[:, k])[number], starts)
        counts = sums.view(np.uint8).astype(np.int64)
        keep = np.ones(len(starts), dtype=bool)
        keep[(first + parts)[:-1]] = False
        return np.add.reduceat(counts[keep], np.cumsum(parts) - parts, axis=0)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    for batch in batches:
        marks = np.array(shingles.simhashes([t or "" for t in batch["text"].to_pylist()]), dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(marks.view(np.int64))], ["doc_id", "mark"])


def content_marks(docs: DataFrame) -> DataFrame:
    """doc_id and mark, the simhash as a signed long, of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_marked, "doc_id long, mark long")


def hash_content(docs: DataFrame) -> DataFrame:
    """docs (text and others) with sha256 and simhash (simhash64-v1: and 16 hex digits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            marks = [f"simhash64-v1:{x:016x}" for x in shingles.simhashes([t or "" for t in batch["text"].to_pylist()])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks)], [*batch.schema.names, "simhash"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, simhash string").withColumn("sha256", F.sha2("text", 256))


#: Marks of one band value up to which all of them are compared.
DENSE = 64


def near_by_bands(marks: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b, distance): ids whose simhash (long, one row for each distinct value) differs in at most 3 of 64 bits.

    Four bands of 16 bits: within three differing bits one band is equal, which makes the join's key. Where more than
    `dense` marks have a value, the other 48 bits are cut into four again, of which one must be equal too, so a value that a
    third of all marks share is split over thousands of keys.
    """
    cut = lambda x, n, width: F.array(*(F.shiftrightunsigned(x, width * i).bitwiseAND((1 << width) - 1) for i in range(n)))
    bands = marks.select("id", "mark", F.posexplode(cut(F.col("mark"), 4, 16)).alias("band", "bits"))
    sizes = bands.groupBy("band", "bits").agg(F.count("*").alias("n")).where("n > 1")
    bands = bands.join(sizes, ["band", "bits"])
    # the bits above a band move down over it
    at = F.col("band") * 16
    above = F.when(F.col("band") == 3, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col("mark"), (at + 16).cast("int")))
    below = F.col("mark").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int")) - 1)
    rest = F.call_function("shiftleft", above, at.cast("int")).bitwiseOR(below)
    few = bands.where(F.col("n") <= dense).select("id", "mark", "band", "bits", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("own"))
    many = bands.where(F.col("n") > dense).select("id", "mark", "band", "bits", F.posexplode(cut(rest, 4, 12)).alias("sub", "own"))
    keyed = few.unionByName(many)
    key = ["band", "bits", "sub", "own"]
    a, b = keyed.select(F.col("id").alias("a"), F.col("mark").alias("ma"), *key), keyed.select(F.col("id").alias("b"), F.col("mark").alias("mb"), *key)
    distance = F.bit_count(F.col("ma").bitwiseXOR(F.col("mb")))
    return a.join(b, key).filter((F.col("a") < F.col("b")) & (distance <= 3)).select("a", "b", distance.alias("distance")).distinct()


def row_hash(prev: str | None, novel: str, seq: int, source: str, old: str | None, new: str, chapter: int) -> str:
    body = json.dumps([novel, seq, source, old, new, chapter, prev], ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(((prev or "") + body).encode()).hexdigest()


def chain(log: DataFrame) -> DataFrame:
    """log (novel_id, seq, source_term, old_target, new_target, changed_at) with prev_hash and row_hash: each row's hash
    covers the one before it. Novels are sorted within partitions and folded batch by batch; only the last hash is carried."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novel, prev = None, None
        for batch in batches:
            before, own = [], []
            for r in batch.to_pylist():
                if r["novel_id"] != novel:
                    novel, prev = r["novel_id"], None
                before.append(prev)
                prev = row_hash(prev, novel, r["seq"], r["source_term"], r["old_target"], r["new_target"], r["changed_at"])
                own.append(prev)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], [*batch.schema.names, "prev_hash", "row_hash"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields)
    return log.repartition("novel_id").sortWithinPartitions("novel_id", "seq").mapInArrow(fold, f"{schema}, prev_hash string, row_hash string")


def broken_links(log: DataFrame) -> DataFrame:
    """Rows whose prev_hash is not the hash of the row before, by a window and no fold."""
    before = F.lag("row_hash").over(W.partitionBy("novel_id").orderBy("seq"))
    return log.withColumn("_before", before).filter(~F.col("prev_hash").eqNullSafe(F.col("_before"))).drop("_before")
