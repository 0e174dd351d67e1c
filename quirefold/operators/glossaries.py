"""Glossaries and names as tables, applied to the texts of their novels.

Texts follow the terms of their novel in one sorted stream of rows. A novel with many bytes of text is split over several
tasks, each of which gets its terms again, packed in blocks. A part has as many bytes as its glossary at least, so the terms that
are sent stay a share of the texts, however long a glossary grows with them. Within a task texts are taken by PART_BYTES: the terms
that may stand in them become one automaton, and every text is walked once. The work is linear in the texts and their hits,
and a task holds the terms of a novel as Arrow arrays, and as Python's objects those that may stand in PART_BYTES of text.

Terms have a source, a target and a kind; names have a key and a spelling. What a text does not hold costs it nothing.
"""

import html
import json
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.operators.deal import dealt, large_keys, repeated
from quirefold.operators.slices import slices

#: Bytes of text of a novel that one automaton is for, and that one task takes at least, if there are so many.
PART_BYTES = 32 << 20
#: Bytes of text of a split novel for each byte of terms, before they are packed, that is sent with them, at least.
TEXT_PER_TERM = 1
#: Terms up to which an automaton is made of all of them.
SOME = 1000
#: Languages written without spaces, where a name needs no boundary.
UNSPACED = {"zh", "ja", "ko"}


class Automaton:
    """All places of a set of strings in a text."""

    def __init__(self, strings: Iterator[str]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for s in strings:
            if s:
                self.found.add_word(s, (len(s), s))
        self.any = len(self.found) > 0
        if self.any:
            self.found.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        """(start, minus the length, string) of every place, those within others included."""
        return [(end - n + 1, -n, s) for end, (n, s) in self.found.iter(text)] if self.any else []

    def held(self, text: str) -> set[str]:
        return {s for _, (_, s) in self.found.iter(text)} if self.any else set()

    def leftmost_longest(self, text: str) -> list[tuple[int, str]]:
        """Places apart: from the left on the first, and of those that start together the longest."""
        out, at = [], 0
        for start, n, s in sorted(self.hits(text)):
            if start >= at:
                out.append((start, s))
                at = start - n
        return out


def stitched(text: str, places: list[tuple[int, str]], told: Callable[[str], str]) -> str:
    """The text with each place, which are in order and apart, replaced by what `told` makes of its string."""
    pieces, at = [], 0
    for start, s in places:
        pieces += [text[at:start], told(s)]
        at = start + len(s)
    return "".join(pieces) + text[at:]


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def whole_name(text: str, start: int, end: int, lang: str | None) -> bool:
    """Whether a match stands alone: no letter is glued to an edge that is a letter itself."""
    if (lang or "").split("-")[0] in UNSPACED:
        return True
    left = start > 0 and _word(text[start - 1]) and _word(text[start])
    right = end < len(text) and _word(text[end]) and _word(text[end - 1])
    return not (left or right)


class Names:
    """Names as whole words that no word character and no hyphen touches; the longest take their places first."""

    def __init__(self, rows: list[dict]):
        self.keys = {r["spelling"]: r["key"] for r in sorted(rows, key=lambda r: str(r["key"]), reverse=True) if r["spelling"]}
        self.automaton = Automaton(iter(self.keys))

    def places(self, text: str) -> list[tuple[int, str]]:
        joint = lambda c: _word(c) or c == "-"
        by_name: dict[str, list[int]] = {}
        for start, _, s in self.automaton.hits(text):
            end = start + len(s)
            own = by_name.setdefault(s, [])
            # a name's own places do not overlap, whether they are free or not
            if not (start and joint(text[start - 1])) and not (end < len(text) and joint(text[end])) and (not own or start >= own[-1] + len(s)):
                own.append(start)
        taken, out = bytearray(len(text)), []
        for s in sorted(by_name, key=lambda s: (-len(s), str(self.keys[s]))):
            for start in by_name[s]:
                if taken.find(1, start, start + len(s)) < 0:
                    taken[start : start + len(s)] = b"\1" * len(s)
                    out.append((start, s))
        return sorted(out)

    def marked(self, row: dict) -> dict:
        places = self.places(row["text"])
        return {"text": stitched(row["text"], places, lambda s: f"⟦{self.keys[s]}⟧"), "order": list(dict.fromkeys(str(self.keys[s]) for _, s in places))}

    def named(self, row: dict) -> list[str]:
        found = {s for _, s in self.places(row["text"])}
        return [str(self.keys[s]) for s in sorted(found, key=lambda s: (-len(s), str(self.keys[s])))]


class Terms:
    """The terms of a novel, those of which neither side is blank, longest source first."""

    def __init__(self, rows: list[dict]):
        rows = sorted((r for r in rows if (r["source"] or "").strip() and (r["target"] or "").strip()), key=lambda r: (-len(r["source"]), r["source"], r["target"]))
        self.target = {r["source"]: r["target"] for r in rows}
        self.number = {r["source"]: r.get("number", i) for i, r in enumerate(rows)}
        self.rows = rows
        self.sources = Automaton(iter(self.target))
        self._targets: Automaton | None = None
        self._places: dict[str, list[int]] | None = None

    @property
    def targets(self) -> Automaton:
        self._targets = self._targets or Automaton(r["target"] for r in self.rows)
        return self._targets

    @property
    def places(self) -> dict[str, list[int]]:
        if self._places is None:
            self._places = {}
            for i, r in enumerate(self.rows):
                self._places.setdefault(r["source"], []).append(i)
        return self._places

    def primed(self, row: dict) -> str:
        return stitched(row["text"], self.sources.leftmost_longest(row["text"]), self.target.__getitem__)

    def converted(self, row: dict) -> dict:
        """The text with sources replaced, and where each stood (begin, end) and stands (start, stop)."""
        pieces, spans, at, new = [], [], 0, 0
        for start, s in self.sources.leftmost_longest(row["text"]):
            new += start - at
            spans.append({"begin": start, "end": start + len(s), "start": new, "stop": new + len(self.target[s])})
            pieces += [row["text"][at:start], self.target[s]]
            at, new = start + len(s), new + len(self.target[s])
        return {"text": "".join(pieces) + row["text"][at:], "spans": spans}

    def protected(self, row: dict) -> str:
        tagged = lambda s: f'<locked-term data-id="t{self.number[s]}">{html.escape(self.target[s])}</locked-term>'
        return stitched(row["text"], self.sources.leftmost_longest(row["text"]), tagged)

    def checked(self, row: dict) -> dict:
        said = row["translated"] or ""
        held, left, there = self.sources.held(row["text"]), self.sources.held(said), self.targets.held(said)
        own = [self.rows[i] for i in sorted(i for s in held for i in self.places[s])]
        missing = [r for r in own if r["target"] not in there]
        kept = [r for r in own if r["source"] not in r["target"] and r["source"] in left]
        return {"empty": not said.strip(), "missing": [r["target"] for r in missing], "untranslated": [r["source"] for r in kept], "hard": any(r["kind"] == "character_name" for r in missing + kept)}


class Spellings:
    """Old spellings (source) with new ones (target), and other names (source, without target), which shield their places."""

    def __init__(self, rows: list[dict], whole: int | None = None):
        """whole: how many old spellings there are, if rows lack those that no text holds."""
        self.new = {r["source"]: r["target"] for r in sorted(rows, key=lambda r: str(r["target"])) if r["source"] and r["target"] is not None and r["source"] != r["target"]}
        self.whole = len(self.new) if whole is None else whole
        self.automaton = Automaton(iter({r["source"] for r in rows if r["source"] and (r["target"] is None or r["source"] in self.new)}))

    def respelled(self, row: dict) -> str | None:
        text = row["text"]
        if not self.whole:
            return text
        hits = [(start, s) for start, s in self.automaton.leftmost_longest(text) if s in self.new and whole_name(text, start, start + len(s), row.get("lang"))]
        return stitched(text, hits, self.new.__getitem__) if len({s for _, s in hits}) == self.whole else None


def _windows(data: np.ndarray, at: np.ndarray | slice, n: int) -> np.ndarray:
    """The n bytes, 8 at most, that begin at places of data (with 8 bytes more behind), as numbers mixed by a product."""
    eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))[at]
    return (eight & np.uint64((1 << 8 * n) - 1)) * np.uint64(0x9E3779B97F4A7C15)


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in a row, with 8 more behind, and where each begins, and the last one ends."""
    own = pc.fill_null(strings.cast(pa.large_binary()), b"")
    ends = np.frombuffer(own.buffers()[1], dtype=np.int64)[own.offset : own.offset + len(own) + 1]
    data = np.frombuffer(own.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return np.concatenate([data, np.zeros(8, dtype=np.uint8)]), ends - ends[0]


def occurring(texts: pa.ChunkedArray, strings: pa.ChunkedArray) -> np.ndarray:
    """Whether each string may stand in one of the texts: none that does is missed, few that do not are told.

    The windows of 8 bytes of all texts, and those of each smaller length that a string has, are bits of a table by hash. A
    string may stand there if its first, last and middle windows do. So what is made of strings grows with the texts that they
    meet, not with all strings of a large glossary.
    """
    chunks = [_bytes(x) for x in texts.chunks]
    shift = np.uint64(64 - min(26, max(12, (8 * sum(len(d) for d, _ in chunks)).bit_length())))
    sizes = [pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False) for x in strings.chunks]
    told = [np.zeros(len(x), dtype=bool) for x in sizes]
    for n in range(1, 9):
        some = [np.flatnonzero(x == n if n < 8 else x >= n) for x in sizes]
        if not any(map(len, some)):
            continue
        there = np.zeros(1 << (64 - int(shift)), dtype=bool)
        for data, _ in chunks:
            for at in range(0, len(data) - 8, 1 << 18):
                there[_windows(data, slice(at, min(at + (1 << 18), len(data) - 8)), n) >> shift] = True
        for own, size, rows, out in zip(strings.chunks, sizes, some, told, strict=True):
            if not len(rows):
                continue
            data, ends = _bytes(own)
            rest = size[rows].astype(np.int64) - n
            out[rows] = np.logical_and.reduce([there[_windows(data, ends[rows] + rest * k // 4, n) >> shift] for k in (range(5) if n == 8 else (0,))])
    return np.concatenate([*told, np.zeros(0, dtype=bool)])


def _numbers(terms: pa.Table) -> pa.Array:
    """The place of each term in the glossary, those with a blank side left out: longest sources first, then by source and target."""
    blank = lambda c: np.array([not (x.as_py() or "").strip() for x in terms[c]], dtype=bool)
    out = blank("source") | blank("target")
    keyed = pa.table({"out": out, "size": pc.negate(pc.fill_null(pc.utf8_length(terms["source"]), 0)), "source": terms["source"], "target": terms["target"]})
    order = pc.sort_indices(keyed, [(c, "ascending") for c in keyed.column_names]).to_numpy()
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    return pa.array(number)


def _counted(terms: pa.Table, kind: type, does: str) -> tuple[pa.Table, dict]:
    """The terms and what else `kind` needs to know of all of them, if it is made of some."""
    more = {}
    if kind is Spellings:
        old = terms.filter(pc.and_(pc.greater(pc.binary_length(terms["source"]), 0), pc.not_equal(terms["source"], terms["target"])))
        more["whole"] = pc.count_distinct(old["source"]).as_py()
    if does == "protected":
        terms = terms.append_column("number", _numbers(terms))
    return terms, more


def _known(texts: pa.Table, terms: pa.Table, kind: type, does: str, more: dict | None = None):
    """`kind` made of those terms that may stand in the texts; of all, if they are few. more: of _counted, if that was asked."""
    if terms.num_rows <= SOME:
        return kind(terms.to_pylist())
    if more is None:
        terms, more = _counted(terms, kind, does)
    there = occurring(texts["text"], terms["spelling" if kind is Names else "source"])
    return kind(terms.filter(pa.array(there)).to_pylist(), **more)


_GROUP = ["_deal_key", "_deal_part", "_deal_text"]


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Sorted batches cut where other values of columns begin, each piece with its values."""
    for batch in batches:
        if batch.num_rows:
            new = np.zeros(batch.num_rows - 1, dtype=bool)
            for c in columns:
                new |= pc.not_equal(batch[c][1:], batch[c][:-1]).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield tuple(batch[c][a].as_py() for c in columns), batch.slice(a, b - a)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the terms of one novel from rows in order, where neighbours begin alike and so pack well."""
    for (key,), piece in _runs(batches, _GROUP[:1]):
        block = zlib.compress(json.dumps([c.to_pylist() for c in piece.columns[1:]], ensure_ascii=False).encode(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([block], pa.binary())], ["_deal_key", "_deal_terms"])


def _unpacked(pieces: Iterator[pa.RecordBatch], none: pa.Table) -> pa.Table:
    blocks = (json.loads(zlib.decompress(b)) for piece in pieces for b in piece["_deal_terms"].to_pylist())
    return pa.concat_tables([none, *(pa.Table.from_arrays([pa.array(c, pa.string()) for c in block], schema=none.schema) for block in blocks)])


def _taken(pieces: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Small batches of texts, in lists of at least `most` bytes of text but for the last."""
    some, size = [], 0
    for part in slices(pieces, "text"):
        some.append(part)
        size += pc.sum(pc.binary_length(part["text"])).as_py() or 0
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


_SPANS = pa.list_(pa.struct([(x, pa.int32()) for x in ("begin", "end", "start", "stop")]))
_CONVERTED = "struct<text:string,spans:array<struct<begin:int,end:int,start:int,stop:int>>>"
_ARROW = {"string": pa.string(), _CONVERTED: pa.struct([("text", pa.string()), ("spans", _SPANS)]), "array<string>": pa.list_(pa.string()), "struct<text:string,order:array<string>>": pa.struct([("text", pa.string()), ("order", pa.list_(pa.string()))]),
          "struct<empty:boolean,missing:array<string>,untranslated:array<string>,hard:boolean>": pa.struct([("empty", pa.bool_()), ("missing", pa.list_(pa.string())), ("untranslated", pa.list_(pa.string())), ("hard", pa.bool_())])}


def _with_terms(texts: DataFrame, terms: DataFrame, fields: tuple[str, ...], kind: type, does: str, out: str, out_type: str, by: str, part_bytes: int, reads: tuple[str, ...] = ("text",)) -> DataFrame:
    """texts with what a method of `kind`, made of the terms of their novel, says of each."""
    texts = texts.drop(out)
    keyed = texts.withColumn("_deal_key", F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")))  # terms without a novel belong to none
    own = terms.where(F.col(by).isNotNull()).select(F.col(by).cast("string").alias("_deal_key"), *(F.col(c).cast("string").alias(f"_term_{c}") for c in fields)).distinct()
    # never null, so no join asks for that anew, and the distinct terms are shuffled once for both uses
    own = own.withColumn("_deal_key", F.coalesce(F.concat(F.lit("="), "_deal_key"), F.lit("")))
    # bytes of a glossary, with some for each row, and so of the texts that it is worth to be sent for
    weight = sum((F.coalesce(F.octet_length(f"_term_{c}"), F.lit(0)) + 4 for c in fields), F.lit(0).cast("long"))
    least = own.groupBy("_deal_key").agg((F.sum(weight) * TEXT_PER_TERM).alias("_least"))
    large = large_keys(keyed, ["_deal_key"], F.coalesce(F.octet_length("text"), F.lit(0)), part_bytes, "_deal_parts", least)
    given = dealt(keyed, ["_deal_key"], large, "_deal_parts", "_deal_part").withColumn("_deal_text", F.lit(True))
    own = own.sortWithinPartitions(*own.columns).mapInArrow(_packed, "_deal_key string, _deal_terms binary")
    own = repeated(own, ["_deal_key"], large, "_deal_parts", "_deal_part").withColumn("_deal_text", F.lit(False))
    rows = given.unionByName(own, allowMissingColumns=True).repartition("_deal_key", "_deal_part").sortWithinPartitions(*_GROUP)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields) + f", `{out}` {out_type}"
    rest, arrow = texts.columns, _ARROW[out_type]
    none = pa.schema([(f, pa.string()) for f in fields]).empty_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, novel in groupby(_runs(batches, _GROUP), lambda x: x[0][:2]):
            known, more = none, {}
            for (*_, is_text), pieces in groupby(novel, lambda x: x[0]):
                if not is_text:
                    known, more = _counted(_unpacked((p for _, p in pieces), none), kind, does)
                    continue
                for some in _taken((p for _, p in pieces), part_bytes):
                    work = getattr(_known(pa.Table.from_batches([p.select(["text"]) for p in some]), known, kind, does, more), does)
                    for part in some:
                        read = part.select([c for c in reads if c in rest]).to_pylist()
                        told = pa.array([None if row["text"] is None else work(row) for row in read], arrow)
                        yield pa.RecordBatch.from_arrays([*(part[c] for c in rest), told], [*rest, out])
                    del work  # before the next one is made

    return rows.mapInArrow(run, schema)


def prime(texts: DataFrame, terms: DataFrame, by: str = "novel_id", part_bytes: int = PART_BYTES) -> DataFrame:
    """texts with `primed`: every source of a term of the text's novel replaced by its target, in one pass, leftmost and longest.

    texts: the column `by`, text and others, which are kept. terms: `by`, source, target; of those with one source the last
    target counts. What was put in is not looked at again. Null texts give null; a novel without terms keeps its texts.
    """
    return _with_terms(texts, terms, ("source", "target"), Terms, "primed", "primed", "string", by, part_bytes)


def protect(texts: DataFrame, terms: DataFrame, by: str = "novel_id", part_bytes: int = PART_BYTES) -> DataFrame:
    """texts with `protected`: like primed, each target in a tag that is to be copied, numbered by the term's place in its
    novel's glossary, longest sources first, then by source."""
    return _with_terms(texts, terms, ("source", "target"), Terms, "protected", "protected", "string", by, part_bytes)


def check(texts: DataFrame, terms: DataFrame, by: str = "novel_id", part_bytes: int = PART_BYTES) -> DataFrame:
    """texts (text, translated) with `violations`: empty, the missing targets, the sources left as they are, and hard, where a
    character's name is concerned (terms have a kind), all by the place of their term in the glossary. A null translation is an empty one."""
    kind = "struct<empty:boolean,missing:array<string>,untranslated:array<string>,hard:boolean>"
    return _with_terms(texts, terms, ("source", "target", "kind"), Terms, "checked", "violations", kind, by, part_bytes, ("text", "translated"))


def respell(texts: DataFrame, spellings: DataFrame, by: str = "novel_id", part_bytes: int = PART_BYTES) -> DataFrame:
    """texts (text, and lang if names need boundaries) with `respelled`: old spellings as whole names replaced by new ones.

    spellings: `by`, source, target; rows with a null target are other names, which shield the places that they take. Null
    unless every old spelling of the novel occurs; the text itself if there are none.
    """
    return _with_terms(texts, spellings, ("source", "target"), Spellings, "respelled", "respelled", "string", by, part_bytes, ("text", "lang"))


def mark(texts: DataFrame, names: DataFrame, by: str = "novel_id", part_bytes: int = PART_BYTES) -> DataFrame:
    """texts with `marked`: text, with every name as a marker of its key, and order, the keys as they first appear.

    names: `by`, key, spelling; of several keys with one spelling the smallest counts. The longest names of the whole text
    take their places first; those of equal length by key.
    """
    return _with_terms(texts, names, ("key", "spelling"), Names, "marked", "marked", "struct<text:string,order:array<string>>", by, part_bytes)


def name(texts: DataFrame, names: DataFrame, by: str = "novel_id", part_bytes: int = PART_BYTES) -> DataFrame:
    """texts with `named`: the keys of the names that stand in the text, longest spellings first, each taking its places
    from shorter ones."""
    return _with_terms(texts, names, ("key", "spelling"), Names, "named", "named", "array<string>", by, part_bytes)


def convert(texts: DataFrame, phrases: DataFrame, by: str = "kind", part_bytes: int = PART_BYTES) -> DataFrame:
    """texts with `converted`: the text in another script, and spans of what was converted, before and after (code points).

    phrases: `by` (such as s2t and t2s), source, target; single characters are phrases of one. At each place the longest
    phrase that begins there is taken, from the left; the rest stays. texts name their conversion in the column `by`.
    """
    return _with_terms(texts, phrases, ("source", "target"), Terms, "converted", "converted", _CONVERTED, by, part_bytes)
