"""Payloads that show names in a chapter and its translation, for a model that aligns them."""

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quirefold.operators.glossaries import Automaton

#: Tokens of a payload, and source paragraphs on each side of a name's place.
PAYLOAD_TOKENS, WINDOW = 3000, 4
_KIND = pa.list_(pa.struct([("source", pa.string()), ("translation", pa.string()), ("display_names", pa.list_(pa.string()))]))


def tokens(text: str) -> int:
    plain = len(text.encode("ascii", "ignore"))
    return plain // 4 + len(text) - plain


def _first_paragraphs(paragraphs: list[str], names: list[str]) -> dict[str, int]:
    """The first paragraph that holds each name; names that none holds are left out. One walk over all paragraphs."""
    known, first = Automaton(iter(set(names))), {}
    for at, p in enumerate(paragraphs):
        for name in known.held(p):
            first.setdefault(name, at)
    return first


def payloads(source: str, display: str, names: list[str], budget: int = PAYLOAD_TOKENS, window: int = WINDOW) -> list[dict]:
    """Names in their order, dealt over payloads of at most `budget` tokens of JSON; one that is larger has one name.

    A name is shown in the displayed paragraph where it first stands (the first one, if it stands nowhere) and in the source
    paragraphs around the same relative place, which is rounded half to even. Each paragraph is shown once a payload.
    """
    left, right = ([p for p in (text or "").split("\n") if p.strip()] for text in (source, display))
    first, ratio = _first_paragraphs(right, names), len(left) / max(len(right), 1)
    out: list[dict] = []
    shown: set[int] = set()
    around: set[int] = set()
    group: list[str] = []

    def told(names_: list[str], shown_: set[int], around_: set[int]) -> dict:
        return {"source": "\n".join(left[i] for i in sorted(around_)), "translation": "\n".join(right[i] for i in sorted(shown_)), "display_names": names_}

    for name in names:
        at = first.get(name, 0)
        centre = round(at * ratio)
        near, own = set(range(max(centre - window, 0), min(centre + window + 1, len(left)))), {at} if right else set()
        more = told([*group, name], shown | own, around | near)
        if group and tokens(json.dumps(more, ensure_ascii=False)) > budget:
            out.append(told(group, shown, around))
            group, shown, around = [], set(), set()
        group, shown, around = [*group, name], shown | own, around | near
    return [*out, told(group, shown, around)] if group else out


def alignment_payloads(chapters: DataFrame, budget: int = PAYLOAD_TOKENS, window: int = WINDOW) -> DataFrame:
    """chapters (source, display, names: an array, and others) with payloads; null or empty names give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "payloads"]
            found = [payloads(s, d, [x for x in n or [] if x], budget, window) for s, d, n in zip(*(batch[c].to_pylist() for c in ("source", "display", "names")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(found, _KIND)], [*rest, "payloads"])

    chapters = chapters.drop("payloads")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chapters.schema.fields)
    return chapters.mapInArrow(run, f"{schema}, payloads array<struct<source:string,translation:string,display_names:array<string>>>")
