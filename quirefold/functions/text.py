"""Text functions as column expressions, with offsets in code points."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence terminators and characters a token, by language.
PROFILES = {"zh": ("。！？…", 1.5), "ja": ("。！？…", 1.5), "ko": (".!?…", 2.0), "en": (".!?…", 4.0)}
#: Marks that end a sentence, and look-alikes of the space and of the hyphen.
ENDERS = ".!?…。！？」』”\"’'）)।॥۔؟։።"
SPACES, HYPHENS = "\u00a0\u202f\u2007\u2009", "\u2010\u2011"
#: Characters that are not of the source script; marks that no glossary term holds.
_HAN = r"[^㐀-䶿一-鿿豈-﫿]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cjk_share(text: Column) -> Column:
    """Han characters as a share of letters, 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{IsHan}]", "")) / letters).otherwise(0.0)


def han_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, _HAN, ""))


def is_prose(line: Column) -> Column:
    """A line of 48 characters or more, or of 24 that ends a sentence."""
    return (F.length(line) >= 48) | ((F.length(line) >= 24) & F.right(line, F.lit(1)).isin(*ENDERS))


def lint(text: Column) -> Column:
    """Look-alike spaces become a space, look-alike hyphens a hyphen."""
    return F.translate(text, SPACES + HYPHENS, " " * len(SPACES) + "-" * len(HYPHENS))


def untranslated(text: Column, source: Column, target: Column, most: int = 30) -> Column:
    """Whether more than `most` Han characters are left in a translation from Chinese into another language."""
    chinese = lambda lang: F.substring_index(lang, "-", 1) == "zh"
    return F.coalesce(chinese(source) & ~chinese(target) & (han_count(text) > most), F.lit(False))


def normalized_rendering(text: Column) -> Column:
    """Lower case, letters and numbers only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def approx_tokens(text: Column) -> Column:
    """A quarter of the ASCII characters, rounded down, and all others."""
    ascii_ = F.length(F.regexp_replace(text, r"[^\x00-\x7f]", ""))
    return F.floor(ascii_ / 4) + F.length(text) - ascii_


def title_part(title: Column) -> Column:
    """A title's ending (k/n): the title without it, and whether more parts follow; other titles as they are."""
    pattern = r"\s*\((\d+)\s*/\s*(\d+)\)\s*$"
    k, n = F.regexp_extract(title, pattern, 1).try_cast("int"), F.regexp_extract(title, pattern, 2).try_cast("int")
    valid = F.coalesce((k >= 1) & (k <= n), F.lit(False))
    return F.struct(F.when(valid, F.regexp_replace(title, pattern, "")).otherwise(title).alias("title"), (valid & F.coalesce(k < n, F.lit(False))).alias("continues"))


def idempotency_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def duration_seconds(text: Column) -> Column:
    """Seconds of a plain number or of '2m3.5s', '2 min 3 sec', '7 seconds'; not below 0; null for anything else."""
    number, unit = r"[0-9]+(?:\.[0-9]+)?", r"(?i)^\s*(?:({0})\s*m(?:in(?:ute)?s?)?\s*)?({0})\s*s(?:ec(?:ond)?s?)?\s*$"
    plain = F.when(text.rlike(r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"), F.trim(text).try_cast("double"))
    minutes = F.coalesce(F.regexp_extract(text, unit.format(number), 1).try_cast("double"), F.lit(0.0))
    found = F.coalesce(plain, minutes * 60 + F.regexp_extract(text, unit.format(number), 2).try_cast("double"))
    return F.when(found.isNotNull(), F.greatest(found, F.lit(0.0)))


def usable_term(source: Column, target: Column, cjk_target: Column) -> Column:
    """Glossary terms: 2 to 80 characters, one line, no sentence marks, no Han in a target that is not of a CJK language."""
    mark = r"[\n\r。！？；：，、]"
    sound = lambda x: F.length(F.trim(x)).between(2, 80) & ~x.rlike(mark)
    return sound(source) & sound(target) & (cjk_target | (han_count(target) == 0))


def sentences(text: Column, terminators: str = ".!?…") -> Column:
    """Sentences with their terminator, blank ones left out; a run of terminators splits after each."""
    return F.filter(F.split(text, f"(?<=[{terminators}])"), lambda x: F.trim(x) != "")


def dereference(text: Column, names: Column, unknown: str = "someone") -> Column:
    """Markers ⟦key⟧ become names[key], or `unknown`."""
    parts = F.split(text, "⟦")

    def name(x: Column, i: Column) -> Column:
        key = F.substring_index(x, "⟧", 1)
        rest = F.substring(x, F.length(key) + 2, F.length(x))
        return F.when((i == 0) | ~F.contains(x, F.lit("⟧")), F.when(i == 0, x).otherwise(F.concat(F.lit("⟦"), x))).otherwise(F.concat(F.coalesce(F.try_element_at(names, key), F.lit(unknown)), rest))

    return F.array_join(F.transform(parts, name), "")
