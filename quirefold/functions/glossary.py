"""Texts around glossary terms, as column expressions: tags, respelling actions, replayed spans, evidence.

Terms and names themselves are applied from tables, by operators.glossaries.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.text import bound

#: Characters that are escaped in marked-up terms.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
_LOCKED = r'(?s)<locked-term data-id="t\d+">(.*?)</locked-term>'


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def quoted(text: Column) -> Column:
    r"""A pattern that matches the text literally; an \E inside it is quoted on its own."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def stitched(text: Column, pattern: Column, told: Callable[[Column], Column]) -> Column:
    """The text with every match of the pattern replaced by what `told` makes of it."""

    def joined(gaps: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m, i: F.concat(told(m), F.get(gaps, i + 1)))
        return F.concat(F.get(gaps, F.lit(0)), F.array_join(pieces, ""))

    return bound(F.split(text, pattern, -1), joined)


def unprotected(text: Column) -> Column:
    """The text without the tags of protected terms; null if one of them is broken."""

    def plain(match: Column) -> Column:
        inner = F.regexp_extract(match, _LOCKED, 1)
        for raw, name in reversed(ENTITIES):
            inner = F.replace(inner, F.lit(name), F.lit(raw))
        return inner

    out = stitched(text, F.lit(_LOCKED), plain)
    return F.when(~F.contains(out, F.lit("<locked-term")) & ~F.contains(out, F.lit("</locked-term")), out)


def whole_word(spelling: Column) -> Column:
    """A pattern for a spelling that no word character and no hyphen touches."""
    return F.concat(F.lit(r"(?U)(?<![\w-])"), quoted(spelling), F.lit(r"(?![\w-])"))


def respell_action(translated: Column, primed_as: Column, target: Column) -> Column:
    """What a new spelling asks for: queue for a chapter not yet translated, retranslate if it is unknown how the term was
    primed, none if it was primed so, respell otherwise."""
    known = F.coalesce(primed_as, F.lit("")) != ""
    return F.when(~translated, "queue").when(~known, "retranslate").when(primed_as == target, "none").otherwise("respell")


def replayed(text: Column, spans: Column) -> Column:
    """text and spans after the confirmed spellings are laid over it: spans (start, end, status, target) that overlap one
    before, are empty or leave the text go; of the others, locked ones show their target, and all get their new places.
    """
    size = F.length(text)
    order = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["end"].alias("end"), s["status"].alias("status"), s["target"].alias("target"))))
    kind = "array<struct<start:int,end:int,from:int,to:int>>"
    first = F.struct(F.lit(0).alias("cursor"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"), F.array().cast(kind).alias("spans"))

    def step(a: Column, s: Column) -> Column:
        fits = (s["start"] >= a["cursor"]) & (s["end"] > s["start"]) & (s["end"] <= size)
        own = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        shown = F.when((s["status"] == "locked") & (F.coalesce(s["target"], F.lit("")) != ""), s["target"]).otherwise(own)
        begin = a["at"] + s["start"] - a["cursor"]
        told = F.struct(begin.alias("start"), (begin + F.length(shown)).alias("end"), s["start"].alias("from"), s["end"].alias("to"))
        pieces = F.concat(a["out"], F.array(F.substring(text, a["cursor"] + 1, s["start"] - a["cursor"]), shown))
        new = F.struct(s["end"].alias("cursor"), (begin + F.length(shown)).alias("at"), pieces.alias("out"), F.array_append(a["spans"], told).alias("spans"))
        return F.when(F.coalesce(fits, F.lit(False)), new).otherwise(a)

    return F.aggregate(order, first, step, lambda a: F.struct(F.concat(F.array_join(a["out"], ""), F.substring(text, a["cursor"] + 1, size)).alias("text"), a["spans"].alias("spans")))


def evidence(text: Column, start: Column, end: Column) -> Column:
    """The sentence around a span: back to the last 。 or line end, on to the next 。, or 180 characters if there is none."""
    before = F.regexp_extract(F.left(text, start), r"(?s)[^。\n]*$", 0)
    behind = F.substring(text, end + 1, F.length(text))
    stop = F.locate("。", behind)
    return F.concat(before, F.substring(text, start + 1, end - start), F.when(stop > 0, F.left(behind, stop)).otherwise(F.left(behind, F.lit(180))))
