"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words: each word carries the mark of the space before it. The distinct words of a batch are
sorted, which lines them up as the depth-first walk of their trie, and the best score of every prefix is kept on a stack,
with the pieces begun in it: a word starts from what the prefix it shares with the one before has there. The best
segmentation of a word is the one whose pieces have the largest sum of scores; of equal sums the one whose last piece is
longest, and so on to the front. Characters that no piece covers become one byte piece for each of their UTF-8 bytes.

Decoding joins the pieces' bytes. Every text comes back exactly, spaces, line ends and the mark's own character included.
"""

from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words, and characters of words, whose pieces a worker remembers; the memory is emptied when it is full.
_REMEMBERED, _REMEMBERED_CHARS = 1 << 18, 1 << 23
#: Longer words share no prefix with others: they are segmented alone, in arrays of some bytes a character.
_LONG = 4096


class Vocabulary:
    """Pieces with ids and scores, as the scored pieces of a model file, in a trie."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """pieces: (text, score, kind) by id; kind is normal, byte or other. All 256 byte pieces must be there."""
        told = [b""] * len(pieces)
        self.of_byte = [-1] * 256
        self.pieces: dict[str, tuple[float, int]] = {}
        self.trie: dict = {}
        for i, (text, score, kind) in enumerate(pieces):
            if kind == "byte":
                self.of_byte[int(text[3:5], 16)], told[i] = i, bytes([int(text[3:5], 16)])
            elif kind == "normal":
                told[i] = text.replace(MARK, " ").encode()
                if MARK not in text[1:]:
                    node = self.trie
                    for c in text:
                        node = node.setdefault(c, {})
                    node[""] = self.pieces[text] = (score, i)
        if -1 in self.of_byte or MARK not in self.pieces:
            raise ValueError("the vocabulary needs a piece for the mark and for every byte")
        self.bytes = pa.array(told, pa.binary())
        self.unknown = min(s for s, _ in self.pieces.values()) - 10
        self.known: dict[str, bytes] = {}
        self.held = 0

    def segment(self, words: list[str]) -> None:
        """Adds the pieces of all words to what is known. words: distinct and sorted, without their marks."""
        # for each prefix of the word before: its best score, its last piece, and the pieces begun but not ended in it
        score, back, begun = [0.0], [(0, -1)], [[]]
        last = ""
        for plain in words:
            word = MARK + plain
            keep = 0
            for x, y in zip(word, last, strict=False):
                if x != y:
                    break
                keep += 1
            del score[keep + 1 :], back[keep + 1 :], begun[keep + 1 :]
            for end in range(keep + 1, len(word) + 1):
                c = word[end - 1]
                best, via, alive = score[end - 1] + self.unknown, (end - 1, -1), []
                starts = begun[end - 1] if c == MARK and end > 1 else [*begun[end - 1], (end - 1, self.trie)]
                for start, node in starts:
                    child = node.get(c)
                    if child is not None:
                        alive.append((start, child))
                        hit = child.get("")
                        if hit and score[start] + hit[0] > best:
                            best, via = score[start] + hit[0], (start, hit[1])
                score.append(best)
                back.append(via)
                begun.append(alive)
            ids, at = [], len(word)
            while at:
                start, i = back[at]
                ids += [i] if i >= 0 else [self.of_byte[b] for b in reversed(word[start:at].encode())]
                at = start
            self.known[plain] = np.array(ids[::-1], dtype=np.int32).tobytes()
            last = word

    def alone(self, plain: str) -> bytes:
        """The pieces of one long word, by the same rule; only the pieces begun but not ended are kept besides arrays."""
        word = MARK + plain
        score, begin, piece = array("d", [0.0]), array("i", [0]), array("i", [-1])
        begun: list[tuple] = []
        for end, c in enumerate(word, 1):
            best, start_of, which, alive = score[-1] + self.unknown, end - 1, -1, []
            if c != MARK or end == 1:
                begun.append((end - 1, self.trie))
            for start, node in begun:
                child = node.get(c)
                if child is not None:
                    alive.append((start, child))
                    hit = child.get("")
                    if hit and score[start] + hit[0] > best:
                        best, start_of, which = score[start] + hit[0], start, hit[1]
            score.append(best)
            begin.append(start_of)
            piece.append(which)
            begun = alive
        ids, at = array("i"), len(word)
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids.extend(self.of_byte[b] for b in reversed(word[begin[at] : at].encode()))
            at = begin[at]
        ids.reverse()
        return ids.tobytes()

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of every text; texts: strings without nulls."""
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        short = [w for w in words if len(w) <= _LONG]
        new = [w for w in short if w not in self.known]
        if len(self.known) + len(new) > _REMEMBERED or self.held > _REMEMBERED_CHARS:
            self.known.clear()
            self.held, new = 0, short
        self.segment(sorted(new))
        self.held += sum(map(len, new))
        found = [self.known[w] if len(w) <= _LONG else self.alone(w) for w in words]
        pool, size = np.frombuffer(b"".join(found), dtype=np.int32), np.array([len(x) // 4 for x in found], dtype=np.int64)
        first = np.cumsum(size) - size
        ends = np.concatenate(([0], np.cumsum(size[which])))
        ids = pool[np.arange(ends[-1]) + np.repeat(first[which] - ends[:-1], size[which])]
        offsets = ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))

    def decode(self, ids: list[int]) -> str:
        return self.texts(pa.array([ids], pa.list_(pa.int32())))[0].as_py()

    def texts(self, ids: pa.ListArray) -> pa.Array:
        """The text of every list of ids, null for null."""
        base = ids.offsets[0].as_py()
        offsets = pa.array(ids.offsets.to_numpy() - base)
        pieces = pa.ListArray.from_arrays(offsets, self.bytes.take(ids.flatten().cast(pa.int32())))
        joined = pc.utf8_slice_codeunits(pc.binary_join(pieces, b"").cast(pa.string()), 1)  # the first word's mark stands for no space
        return pc.if_else(ids.is_valid(), joined, pa.scalar(None, pa.string()))


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    """The vocabulary of a SentencePiece model file's bytes. Only pieces and scores are read."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    kinds = ["byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal" for i in range(m.get_piece_size())]
    return Vocabulary([(m.id_to_piece(i), m.get_score(i), kind) for i, kind in enumerate(kinds)])


def _parts(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes in the column, so that a batch of long texts stays small."""
    a = batch[column]
    width = a.offsets if isinstance(a, pa.ListArray) else pc.cumulative_sum(pa.concat_arrays([pa.array([0]), pc.fill_null(pc.binary_length(a), 0).cast(pa.int64())]))
    ends, at = width.to_numpy(), 0
    while at < len(a):
        n = max(1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1 - at)
        yield batch.slice(at, n)
        at += n


def _encoded(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    words = vocabulary(model)
    for batch in batches:
        rest = [c for c in batch.schema.names if c != "text"]
        for part in _parts(batch, "text"):
            yield pa.RecordBatch.from_arrays([*(part[c] for c in rest), words.encode(pc.fill_null(part["text"], ""))], [*rest, "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    words = vocabulary(model)
    for batch in batches:
        rest = [c for c in batch.schema.names if c != "ids"]
        for part in _parts(batch, "ids"):
            yield pa.RecordBatch.from_arrays([*(part[c] for c in rest), words.texts(part["ids"])], [*rest, "text"])


def _schema(df: DataFrame, without: str, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != without), more])


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """docs with ids (array of int) in place of text; other columns are kept, but one named ids is replaced.

    A null text is encoded like an empty one, which is one piece, the mark.
    """
    docs = docs.drop("ids").withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(partial(_encoded, model=model), _schema(docs, "text", "ids array<int>"))


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """encoded with text in place of ids; other columns are kept, but one named text is replaced. Null ids give null."""
    encoded = encoded.drop("text")
    return encoded.mapInArrow(partial(_decoded, model=model), _schema(encoded, "ids", "text string"))
