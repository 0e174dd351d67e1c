"""Answers of models read as data: tagged facts, names, fields between bars, citations, quotas."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.glossary import stitched, strip

#: Categories of facts, kinds of names, and statuses of facts in fields.
CATEGORIES = ("ability", "affiliation", "alias", "event", "intro", "item", "place", "relationship", "status")
NAME_KINDS = ("item", "organization", "place")
STATUSES = ("advanced", "confirmed", "expected", "happened", "implied", "ongoing", "opened", "plan", "resolved", "threat", "uncertain")
_LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"
#: Patterns of the lines of facts and names, and of references to chapters, as answers are written.
_FACT = r"(?iU)^\s*(?:[-*•]|\d+[.)])?\s*([a-z]+)(?:\s*:\s*([a-z][a-z -]*?))?\s*\|\s*(.+?)\s*$"
_NAME = r"(?iU)^\s*(?:[-*•]|\d+[.)])?\s*([a-z]+)\s*\|\s*(.+?)\s*$"
_REF = r"ch\.?\s*\d+(?:\s*[–-]\s*\d+)?"
_CITATION = rf"\(\s*{_REF}(?:\s*[,;]\s*(?:{_REF}|\d+(?:\s*[–-]\s*\d+)?))*+\s*\)"


def _lines(text: Column) -> Column:
    return F.split(text, _LINE_END)


def section(text: Column, name: str) -> Column:
    """What stands under the last heading of this name, up to the next heading; null without one."""
    heading = rf"(?imdU)^##\s*{name}\s*$"
    return F.when(text.rlike(heading), F.element_at(F.split(F.element_at(F.split(text, heading), -1), r"(?md)^## ", 2), 1))


def _after_last_heading(text: Column) -> Column:
    return F.element_at(F.split(text, r"(?md)^## .*$"), -1)


def facts_body(text: Column) -> Column:
    return F.coalesce(section(text, "Facts"), _after_last_heading(text))


def parse_tagged(text: Column) -> Column:
    """category, kind and text of each line of the facts' section; lines of unknown categories go, and those where a kind
    stands for another category than a relationship, or is missing there.
    """

    def read(line: Column) -> Column:
        kind = F.lower(strip(F.regexp_extract(line, _FACT, 2)))
        return F.struct(F.lower(F.regexp_extract(line, _FACT, 1)).alias("category"), F.when(kind != "", kind).alias("kind"), F.regexp_extract(line, _FACT, 3).alias("text"))

    rows = F.transform(F.filter(_lines(facts_body(text)), lambda x: x.rlike(_FACT)), read)
    return F.filter(rows, lambda r: r["category"].isin(*CATEGORIES) & ((r["category"] == "relationship") == r["kind"].isNotNull()))


def says_none(text: Column) -> Column:
    return F.lower(strip(facts_body(text))) == "none"


def parse_names(text: Column) -> Column:
    """kind and name of each line of the names' section whose kind is known."""
    rows = F.transform(F.filter(_lines(F.coalesce(section(text, "Names"), F.lit(""))), lambda x: x.rlike(_NAME)), lambda x: F.struct(F.lower(F.regexp_extract(x, _NAME, 1)).alias("kind"), F.regexp_extract(x, _NAME, 2).alias("name")))
    return F.filter(rows, lambda r: r["kind"].isin(*NAME_KINDS))


def parse_fields(text: Column) -> Column:
    """facts (category, status, names, fact, known_status) and unparsed: lines after the last heading, four fields between
    bars; the fact stands last and may hold bars; names are parted by semicolons.
    """
    bare = F.transform(_lines(_after_last_heading(text)), lambda x: strip(F.regexp_replace(x, r"(?U)^\s*(?:[-*]|\d+[.)])\s+", "")))
    parts = F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.struct(x.alias("line"), F.transform(F.split(x, r"\|", 4), strip).alias("p")))
    whole = lambda r: (F.size(r["p"]) == 4) & (F.get(r["p"], F.lit(3)) != "")

    def fact(r: Column) -> Column:
        status = F.lower(F.get(r["p"], F.lit(1)))
        names = F.filter(F.transform(F.split(F.get(r["p"], F.lit(2)), ";"), strip), lambda n: n != "")
        return F.struct(F.lower(F.get(r["p"], F.lit(0))).alias("category"), status.alias("status"), names.alias("names"), F.get(r["p"], F.lit(3)).alias("fact"), status.isin(*STATUSES).alias("known_status"))

    return F.struct(F.transform(F.filter(parts, whole), fact).alias("facts"), F.transform(F.filter(parts, lambda r: ~whole(r)), lambda r: r["line"]).alias("unparsed"))


def audit_citations(text: Column, allowed: Column, gate: int) -> Column:
    """labels, invalid (not in allowed, an array of 'id:chapter'), future (after the gate) and malformed of [chunk:id ch:n]."""
    pattern = r"\[chunk:([^\s\]]+)\s+ch:(\d+)\]"
    ids, chapters = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda n: n.try_cast("long"))
    told = F.zip_with(ids, chapters, lambda i, n: F.concat_ws(":", i, n))
    n = F.size(ids)
    return F.struct(n.alias("labels"), F.size(F.filter(told, lambda x: ~F.array_contains(allowed, x))).alias("invalid"), F.size(F.filter(chapters, lambda c: c > gate)).alias("future"), F.greatest(F.lit(0), F.size(F.split(text, r"\[chunk:")) - 1 - n).alias("malformed"))


def tidy_citations(page: Column) -> Column:
    """(ch4, ch5) and (ch. 3-4) become (ch. 4, 5) and (ch. 3–4)."""

    def one(match: Column) -> Column:
        parts = F.regexp_extract_all(match, F.lit(r"\d+(?:\s*[–-]\s*\d+)?"), F.lit(0))
        return F.concat(F.lit("(ch. "), F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"\s*[–-]\s*", "–")), ", "), F.lit(")"))

    return stitched(page, F.lit(_CITATION), one)


def supported_alias(alias: Column, name: Column, chapter: Column, facts: Column) -> Column:
    """Whether a fact (chapter, text) of the chapter names both the alias and its subject, in any case of letters."""
    holds = lambda f, x: F.contains(F.lower(f["text"]), F.lower(x))
    return F.exists(facts, lambda f: (f["chapter"] == chapter) & holds(f, alias) & holds(f, name))


def token_quota(text: Column, most: int = 10**12) -> Column:
    """limit_tokens, used_tokens and requested_tokens that a message about tokens names; of repeats the last."""
    field = r"(?i)\b(limit|used|requested)\s*[:=]?\s*([0-9]{1,3}(?:,[0-9]{3})*+|[0-9]{1,15})\b"
    about = text.rlike(r"(?i)\b(?:tokens?|tpm|token\s+per\s+minute)\b")
    names, values = F.transform(F.regexp_extract_all(text, F.lit(field), F.lit(1)), F.lower), F.transform(F.regexp_extract_all(text, F.lit(field), F.lit(2)), lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("long"))
    pairs = F.filter(F.arrays_zip(names.alias("name"), values.alias("n")), lambda p: p["n"] <= most)
    last = lambda k: F.when(about, F.element_at(F.transform(F.filter(F.concat(F.array(F.struct(F.lit(k).alias("name"), F.lit(None).cast("long").alias("n"))), pairs), lambda p: p["name"] == k), lambda p: p["n"]), -1))
    return F.struct(*(last(k).alias(f"{k}_tokens") for k in ("limit", "used", "requested")))
