"""Keys by hash: canonical JSON, fingerprints, stable ids, vector spaces."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the name space of ids made from addresses.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Characters that JSON writes by a letter.
_LETTERS = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def json_string(text: Column, ascii_only: bool = False) -> Column:
    """A string as JSON: other control characters, and with ascii_only all but ASCII, as UTF-16 units by number."""
    out = text
    for raw, told in _LETTERS:
        out = F.replace(out, F.lit(raw), F.lit(told))

    def told_by_number(c: Column) -> Column:
        code = F.ascii(c)
        high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)
        wide = F.concat(_unit(high), _unit(low))
        return F.when((code >= 32) & (code < 127 if ascii_only else F.lit(True)), c).when(code > 0xFFFF, wide).otherwise(_unit(code))

    odd = r"[^\x20-\x7e]" if ascii_only else r"[\x00-\x1f]"
    whole = F.array_join(F.transform(F.filter(F.split(out, ""), lambda c: c != ""), told_by_number), "")
    return F.concat(F.lit('"'), F.when(out.rlike(odd), whole).otherwise(out), F.lit('"'))


def json_list(*parts: Column, separator: str = ", ") -> Column:
    """A list of values that are JSON already."""
    return F.concat(F.lit("["), F.concat_ws(separator, *parts), F.lit("]"))


def fingerprint(*parts: Column) -> Column:
    """The SHA-256 of a compact JSON list of strings."""
    return F.sha2(json_list(*(json_string(p) for p in parts), separator=","), 256)


def stable_id(*parts: Column) -> Column:
    """A UUID of version 5 of a JSON list of strings, in the name space of addresses."""
    name = json_list(*(json_string(p) for p in parts))
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(name, "UTF-8")))
    nibble = F.substring(F.lit("0123456789abcdef"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 9, F.lit(1))
    return F.concat_ws("-", F.left(digest, F.lit(8)), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(nibble, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def embedding_space(provider: Column, model: Column, dimensions: Column, endpoint: Column) -> Column:
    """The id of a vector space: what serves it, under which name, how wide, and where."""
    parts = [json_string(provider, True), json_string(F.regexp_replace(model, "^models/", ""), True), dimensions.cast("string"), json_string(F.regexp_replace(endpoint, "/+$", ""), True)]
    return F.sha2(json_list(*parts), 256)


def bound_space(provider: Column, model: Column, hosted: Column, has_credential: Column, server: dict, dimensions: int, default_model: str) -> Column:
    """The vector space that a configuration (provider and model, null without one) stands for; null if search is off.

    Without one, hosted installations choose by themselves, others take the server's; hosted ones never take the server's.
    server: provider, model, and the endpoints by provider. gemini and openrouter need a credential.
    """
    public = {"gemini": "https://generativelanguage.googleapis.com/v1beta", "openrouter": "https://openrouter.ai/api/v1"}
    named = F.coalesce(provider, F.when(hosted, "auto").otherwise("server"))
    named = F.when(hosted & (named == "server"), "auto").otherwise(named)
    own = named == "server"
    kind = F.when(own, F.lit(server["provider"])).otherwise(named)
    auto = kind == "auto"
    chosen = F.when(auto, F.lit(default_model)).when(own, F.lit(server["model"])).otherwise(F.coalesce(model, F.lit("")))
    kind = F.when(auto, "gemini").otherwise(kind)
    at = lambda names: F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), kind)
    remote = kind.isin(*public)
    endpoint = F.when(remote & ~own, at(public)).otherwise(at(server["endpoints"]))
    usable = (kind != "disabled") & (~remote | has_credential)
    return F.when(usable, embedding_space(kind, chosen, F.lit(dimensions), endpoint))


def credential_fingerprint(provider: Column, url: Column, credential: Column) -> Column:
    """Half a SHA-256 that tells credentials apart and does not give them away."""
    part = lambda name: F.coalesce(F.parse_url(url, F.lit(name)), F.lit(""))
    stable = F.concat(F.lower(part("PROTOCOL")), F.lit("://"), F.lower(part("AUTHORITY")), F.regexp_replace(part("PATH"), "/+$", ""))
    return F.left(F.sha2(F.concat_ws("\x1f", provider, stable, credential), 256), F.lit(32))


def cacheable(requested: Column, served_provider: Column, served_model: Column) -> Column:
    """Whether what was served is what was asked for, so that it may be kept under that key."""
    return F.concat_ws(":", served_provider, served_model) == requested
