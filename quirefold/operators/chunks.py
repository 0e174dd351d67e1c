"""Token-budget chunks with offsets, one fold for each text."""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import PROFILES
from quirefold.operators.glossaries import Automaton
from quirefold.operators.slices import slices

#: Characters of a paragraph up to which each sentence is looked for by itself.
_SHORT = 4096
_KIND = pa.list_(pa.struct([("ordinal", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def sentences(paragraph: str, ends: str) -> list[str]:
    """A paragraph cut after every terminator; blank pieces are left out."""
    return [x for x in re.split(f"(?<=[{re.escape(ends)}])", paragraph) if x.strip()]


def first_places(text: str, begin: int, paragraph: str, parts: list[str]) -> dict[str, int]:
    """Where each part of a paragraph first occurs in it; all at once, so long paragraphs take linear time."""
    if len(paragraph) < _SHORT:
        return {x: text.index(x, begin) for x in parts}
    places: dict[str, int] = {}
    for start, _, x in Automaton(iter(set(parts))).hits(paragraph):
        places.setdefault(x, begin + start)
    return places


def chunk(text: str, lang: str | None, budget: int) -> list[dict]:
    """Whole sentences packed up to `budget` tokens, over paragraphs too; a longer sentence stays whole.

    Paragraphs are cut at blank lines. A sentence stands where its text first occurs in its paragraph, so one that is
    repeated counts as standing at the first place. text[start:end] is the chunk.
    """
    ends, per_token = PROFILES.get(lang or "", PROFILES["en"])
    out, start, end, size, at = [], None, 0, 0.0, 0
    for paragraph in text.split("\n\n"):
        begin, at = at, at + len(paragraph) + 2
        parts = sentences(paragraph, ends)
        places = first_places(text, begin, paragraph, parts)
        for sentence in parts:
            cost, place = len(sentence) / per_token, places[sentence]
            if start is not None and size + cost > budget:
                out.append((start, end))
                start, size = None, 0.0
            start = place if start is None else start
            end, size = place + len(sentence), size + cost
    if start is not None:
        out.append((start, end))
    return [{"ordinal": i, "text": text[a:b], "start": a, "end": b} for i, (a, b) in enumerate(out)]


def chunk_text(docs: DataFrame, budget: int = 400) -> DataFrame:
    """docs (text, lang and others) with chunks: ordinal, text, start, end (code points, half-open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [chunk(t or "", lang, budget) for t, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _KIND)], [*batch.schema.names, "chunks"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, chunks array<struct<ordinal:int,text:string,start:int,end:int>>")


def translation_parts(docs: DataFrame, budget: int = 6000) -> DataFrame:
    """One row for each part of a text to translate: docs' columns without text, part (from 0) and its text.

    Parts are chunks; one that is larger than the budget, being one sentence, is cut. Blank parts are left out.
    """
    if budget < 1:
        raise ValueError("the budget must be positive")
    rest = [c for c in docs.columns if c != "text"]
    rates = {lang: max(1, int(budget * rate)) for lang, (_, rate) in PROFILES.items()}
    most = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in rates.items() for x in pair)), F.col("lang")), F.lit(rates["en"]))
    cut = F.transform("chunks", lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.length(c["text"]) - 1) / most).cast("int")), lambda i: F.substring(c["text"], i * most + 1, most)))
    blank = F.filter(F.flatten(cut), lambda x: x.rlike(r"(?U)\S"))
    return chunk_text(docs, budget).select(*rest, F.posexplode(blank).alias("part", "text"))
