import hashlib
import random
import time
import unicodedata

import numpy as np

from quirefold.operators import hashing

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute(text: str, size: int = 5) -> int:
    plain = " ".join(unicodedata.normalize("NFKC", text).lower().split())
    marks = [int.from_bytes(hashlib.sha256(plain[k : k + size].encode("utf-8", "surrogatepass")).digest()[:8], "big") for k in range(max(1, len(plain) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in marks) > len(marks))


def test_odd_texts():
    """Few and very many characters, what a task remembers run over, and lengths about the blocks of 255 places."""
    draw = random.Random(7)
    pools = ["ab ", "a\ud800\U0001f600Ａ", "".join(map(chr, range(0x4E00, 0x4E00 + 4000))), "".join(map(chr, range(0x5E00, 0x5E00 + 4000)))]
    for most in (1 << 20, 10):
        shingles = hashing.Shingles(most=most)
        for pool in pools * 2:
            texts = ["".join(draw.choice(pool) for _ in range(n)) for n in (0, 1, 4, 5, 6, 258, 259, 260, 514, 515, 9)]
            assert shingles.simhashes(texts) == [brute(x) for x in texts]
    wide = "".join(map(chr, range(0x3400, 0x3400 + 6500))) + "".join(map(chr, range(0x5000, 0x5000 + 2000)))  # too many for a key
    assert hashing.Shingles().simhashes([wide, "short", "longer text"]) == [brute(x) for x in (wide, "short", "longer text")]


def test_marks_of_content(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = hashing.content_marks(docs)
    assert got.columns == ["doc_id", "mark"]  # texts do not come back
    want = {r.doc_id: int(r.simhash[13:], 16) for r in hashing.hash_content(docs.select("doc_id", "text")).collect()}
    assert {r.doc_id: r.mark % 2**64 for r in got.collect()} == want


def test_time_of_remembered_shingles(spark):
    """Once its shingles are known, a text's SimHash takes less time than sorting its shingles, with which it began before."""
    texts = [r.text or "" for r in spark.read.parquet(f"{LARGE}/documents.parquet").orderBy("doc_id").limit(400).collect()]
    texts = [" ".join(unicodedata.normalize("NFKC", x).lower().split()) for x in texts]
    joined = "".join(texts)[:500_000]
    shingles = hashing.Shingles()
    shingles.simhashes([joined])
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)

    def best(f):
        took = []
        for _ in range(5):
            at = time.process_time()
            f()
            took.append(time.process_time() - at)
        return min(took)

    key = sum(points[k : len(points) - 4 + k].astype(np.int64) << (12 * k) for k in range(5))
    assert best(lambda: shingles.votes(joined, np.array([len(joined)]))) < best(lambda: np.unique(key, return_index=True, return_inverse=True))
