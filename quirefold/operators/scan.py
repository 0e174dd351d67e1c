"""Exact mention scans: leftmost-longest, non-overlapping, with code-point and byte offsets.

The dictionary is shipped to the tasks once and an automaton is kept for each worker. Its size is checked: a dictionary
beyond the limit is refused rather than sent.
"""

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.operators.glossaries import UNSPACED, Automaton, whole_name

MAX_ALIASES = 100_000
_SPAN = "struct<alias_id:string,byte_start:int,byte_end:int,char_start:int,char_end:int>"


class Aliases:
    """The ids of every surface, and an automaton of the surfaces."""

    def __init__(self, aliases: tuple[tuple[str, str], ...]):
        ids: dict[str, set] = {}
        for alias_id, surface in aliases:
            if surface:
                ids.setdefault(surface, set()).add(alias_id)
        self.ids = {s: (sorted(x), len(s.encode())) for s, x in ids.items()}
        self.automaton = Automaton(iter(self.ids))


@lru_cache(maxsize=4)
def _known(aliases: tuple[tuple[str, str], ...]) -> Aliases:
    return Aliases(aliases)


_FIELDS = ("alias_id", "byte_start", "byte_end", "char_start", "char_end")


def spans(text: str, lang: str | None, known: Aliases, out: dict[str, list]) -> None:
    """Adds the spans of one text to the columns of out. A longest match without boundary still uses up its characters."""
    if not text:
        return
    plain, free = text.isascii(), (lang or "").split("-")[0] in UNSPACED
    at, seen = 0, 0
    for start, surface in known.automaton.leftmost_longest(text):
        end = start + len(surface)
        if not free and not whole_name(text, start, end, lang):
            continue
        if plain:
            at = start
        else:
            at += len(text[seen:start].encode())
            seen = start
        ids, size = known.ids[surface]
        for i in ids:
            for name, value in zip(_FIELDS, (i, at, at + size, start, end), strict=True):
                out[name].append(value)


def scan_mentions(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """docs (text, lang and others) with spans, an array by position, then alias id.

    aliases: alias_id, surface; empty surfaces are ignored. A surface of several aliases gives a span for each.
    """
    rows = aliases.filter("surface is not null and surface != ''").select("alias_id", "surface").distinct().limit(MAX_ALIASES + 1).collect()
    if len(rows) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} aliases; join by words instead")
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(sorted((str(r[0]), r[1]) for r in rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shipped.value)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _FIELDS}
            ends = [0]
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                spans(text, lang, known, out)
                ends.append(len(out["alias_id"]))
            columns = [pa.array(out[k], pa.string() if k == "alias_id" else pa.int32()) for k in _FIELDS]
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, list(_FIELDS)))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, spans array<{_SPAN}>")


def without_overlap(new: str, old: str):
    """Spans of column `new` that overlap none of column `old`."""
    return F.filter(new, lambda n: ~F.exists(old, lambda o: (n["char_start"] < o["char_end"]) & (o["char_start"] < n["char_end"])))


def presence(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc columns, term columns): terms (column term) that a text contains, as substrings; the empty one is in every text.

    The texts are searched for up to MAX_ALIASES distinct terms at a time; more of them are dealt by hash into as many
    passes as are needed, so the driver never holds more than about that many.
    """
    own = terms.where("term is not null").select("term").distinct()
    passes = -(-own.count() // (MAX_ALIASES * 4 // 5)) or 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def searched(shipped):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            found = ahocorasick.Automaton()
            for term in shipped.value:
                if term:
                    found.add_word(term, term)
            if len(found):
                found.make_automaton()
            always = [""] if "" in shipped.value else []
            for batch in batches:
                hits = [None if text is None else sorted({x for _, x in found.iter(text)} if len(found) else ()) + always for text in batch["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.list_(pa.string()))], [*batch.schema.names, "_terms"])

        return run

    out = None
    for i in range(passes):
        part = [r[0] for r in own.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == i).collect()]
        hits = docs.mapInArrow(searched(docs.sparkSession.sparkContext.broadcast(part)), f"{schema}, _terms array<string>").withColumn("term", F.explode("_terms")).drop("_terms")
        out = hits if out is None else out.unionByName(hits)
    return out.join(terms, "term")
