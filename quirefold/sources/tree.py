"""Pages as trees of elements numbered by intervals, and what is asked of such trees as column expressions.

One Arrow function reads each page once and gives its elements in document order as an array column. An element has its
number (pre) and the number after its last descendant (end), so "within" is a comparison of numbers, and a selector is a
filter of the array. Candidate blocks for the chapter also get their weight, from running sums of the lengths of
paragraphs, lines and links: each block takes two look-ups a sum, however deep blocks are nested.
"""

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import ENDERS, bound
from quirefold.operators.slices import slices

#: Elements without content, blocks that may hold a chapter, and elements that never hold prose.
VOID = {"br", "img", "meta", "link", "hr", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
CANDIDATES = ("div", "article", "section", "main", "td")
NOISE = ("script", "style", "noscript", "iframe", "nav", "header", "footer", "aside", "form", "button", "select", "textarea", "svg")
#: By the element that begins, those open ones that it ends, as pages leave end tags out.
_BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
_ENDS = {**dict.fromkeys(_BLOCKS, ("p",)), "li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), "option": ("option",), "a": ("a",)}
#: What an end of the kinds above does not reach across.
_WALLS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}
#: Elements that ends of others do not reach across, those whose ends leave what stands between open, those that
#: wall ends off but for their own and those of table parts, and those in which a slash does end an element.
_SPECIAL = {*_BLOCKS, *"body br button caption center colgroup dd dir dt figcaption head html iframe li marquee noscript object script select style summary tbody td template textarea tfoot th thead title tr".split(), *VOID}
_FORMATS = set("a b big code em font i nobr s small strike strong tt u".split())
_ENDING = _SPECIAL | _FORMATS
_SCOPES = {"table", "td", "th", "caption", "marquee", "object", "template"}
_TABLE = {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}
_FOREIGN = {"svg", "math"}
#: Elements that cannot stand in a drawing and so end it, but for those parts of it that hold a page's elements.
_OUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_HOLDS = {"foreignobject", "desc", "title"}
_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TOLD = {"a", "h1", "h2", "h3", "h4", "title"}
#: Characters of a line that make its stem, and those from which a line is prose if it ends a sentence.
_STEM, _PROSE = 10, 24

_NODE = pa.struct([("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("rel", pa.string()), ("href", pa.string()), ("link", pa.string()), ("pre", pa.int32()), ("end", pa.int32()), ("depth", pa.int32()), ("from", pa.int32()), ("upto", pa.int32()), ("text", pa.string()), ("weight", pa.float64())])
_PARAGRAPH = pa.struct([("pre", pa.int32()), ("text", pa.string())])
_TREE = pa.struct([("nodes", pa.list_(_NODE)), ("paragraphs", pa.list_(_PARAGRAPH)), ("broken", pa.string())])
_SCHEMA = "struct<nodes:array<struct<tag:string,id:string,classes:array<string>,rel:string,href:string,link:string,pre:int,end:int,depth:int,from:int,upto:int,text:string,weight:double>>,paragraphs:array<struct<pre:int,text:string>>,broken:string>"


def normalized(text: str) -> str:
    """With plain spaces for no-break and ideographic ones, and without white space at both ends."""
    return text.replace(" ", " ").replace("　", " ").strip()


class _Parser(HTMLParser):
    """Elements in document order; their text as ranges of characters of one plain and one line-broken text."""

    def __init__(self, noise: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.noise = noise
        self.skipped: list[str] = []  # open elements from one of noise on
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.plain, self.broken, self.at, self.line_at = [], [], 0, 0

    def put(self, text: str, plain: bool = True) -> None:
        self.broken.append(text)
        self.line_at += len(text)
        if plain:
            self.plain.append(text)
            self.at += len(text)

    def shut(self, upto: int, most: int | None = None) -> None:
        """Ends all open elements from the given place of the stack on, or `most` of them and of those the outermost."""
        while len(self.open) > upto and most != 0:
            node = self.nodes[self.open.pop(-1 if most is None else upto)]
            most = None if most is None else most - 1
            if node["tag"] in ("p", "div"):
                self.put("\n", plain=False)
            node |= {"end": len(self.nodes), "c1": self.at, "upto": self.line_at}

    def handle_starttag(self, tag, attrs):
        if tag in _OUT and "svg" in self.skipped:
            k = len(self.skipped) - 1 - self.skipped[::-1].index("svg")
            if not _HOLDS.intersection(self.skipped[k:]):
                del self.skipped[k:]
        if self.skipped:
            self.skipped += [tag] if tag not in VOID else []
            return
        for other in _ENDS.get(tag, ()):
            for k in range(len(self.open) - 1, -1, -1):
                name = self.nodes[self.open[k]]["tag"]
                if name in _WALLS.get(tag, ()) or (name in ("td", "th", "button", "table") and other == "p") or (name in _SCOPES and other == "a"):
                    break
                if name == other:
                    across = other == "a" and any(self.nodes[i]["tag"] in _SPECIAL for i in self.open[k + 1 :])
                    self.shut(k, 1 if across else None)
                    break
        if tag in self.noise:
            self.skipped += [tag] if tag not in VOID else []
            return
        if tag in ("br", "p", "div"):
            self.put("\n", plain=False)
        named = {k: v or "" for k, v in reversed(attrs)}
        self.nodes.append({"tag": tag, "id": named.get("id"), "classes": (named.get("class") or "").split(), "rel": named.get("rel"), "href": named.get("href"), "pre": len(self.nodes), "end": len(self.nodes) + 1, "depth": len(self.open), "c0": self.at, "c1": self.at, "from": self.line_at, "upto": self.line_at})
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        """A slash does not end an element that has content, but in drawings and formulas."""
        opened, skipped = len(self.open), len(self.skipped)
        ends = tag not in VOID and (tag in _FOREIGN or not _FOREIGN.isdisjoint(self.skipped) or any(self.nodes[k]["tag"] in _FOREIGN for k in self.open))
        self.handle_starttag(tag, attrs)
        if ends:
            del self.skipped[skipped:]
            self.shut(opened)

    def handle_endtag(self, tag):
        if tag in self.skipped:
            del self.skipped[len(self.skipped) - 1 - self.skipped[::-1].index(tag) :]
            return
        if tag in ("body", "html") or (self.skipped and tag not in _ENDING):
            return  # what follows the end of a body belongs to it
        if tag == "br":
            return self.handle_starttag(tag, [])
        crossed = False
        for k in range(len(self.open) - 1, -1, -1):
            name = self.nodes[self.open[k]]["tag"]
            if name == tag or (name in _HEADS and tag in _HEADS):
                if tag in _FORMATS and (crossed or self.skipped):
                    self.shut(k, 1)
                else:
                    self.skipped.clear()
                    self.shut(k)
                return
            if name in _SCOPES and (tag not in _TABLE or name == "table"):
                break
            crossed |= name in _SPECIAL
            if crossed and tag not in _ENDING:
                break
        if tag == "p" and not self.skipped:  # an end without a beginning is an empty paragraph
            self.handle_starttag(tag, [])
            self.shut(len(self.open) - 1)

    def handle_data(self, data):
        if not self.skipped:
            self.put(data)


class _Lines:
    """Running sums over lines: how many, their lengths, those of prose, and a majority of stems."""

    def __init__(self, lines: list[str]):
        size = np.array([len(x) for x in lines], dtype=np.int64)
        prose = np.array([len(x) >= 2 * _PROSE or (len(x) >= _PROSE and x[-1] in ENDERS) for x in lines], dtype=bool)
        names: dict[str, int] = {}
        stem = np.array([names.setdefault(x[:_STEM], len(names)) if len(x) >= _STEM else -1 for x in lines], dtype=np.int64)
        sums = lambda x: np.concatenate(([0], np.cumsum(x)))
        self.n, self.size, self.prose, self.prose_n = sums(size > 0), sums(size), sums(size * prose), sums(prose)
        self.stems = sums(stem >= 0)
        self.bits = [sums((stem >= 0) & (stem >> b & 1 == 1)) for b in range(max(len(names) - 1, 0).bit_length())]
        self.count = len(lines) + 1
        self.places = np.sort(stem * self.count + np.arange(len(lines)))

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether of the lines from a up to b, at least four and three fifths of them open with the same stem.

        Such a stem is that of most lines that have one, so each of its bits is what most of their bits are.
        """
        all_ = self.stems[b] - self.stems[a]
        top = np.zeros(len(a), dtype=np.int64)
        for k, bit in enumerate(self.bits):
            top |= (2 * (bit[b] - bit[a]) > all_).astype(np.int64) << k
        n = np.searchsorted(self.places, top * self.count + b) - np.searchsorted(self.places, top * self.count + a)
        return (n >= 4) & (10 * n >= 6 * (self.n[b] - self.n[a])) & (self.n[b] - self.n[a] >= 4)

    def weights(self, a: np.ndarray, b: np.ndarray, links: np.ndarray, floor: int) -> np.ndarray:
        total, prose = self.size[b] - self.size[a], self.prose[b] - self.prose[a]
        density = links / np.maximum(total, 1)
        good = (total > 0) & (self.prose_n[b] - self.prose_n[a] >= 2) & (prose >= floor) & (density <= 0.3)
        if good.any():
            good &= ~self.alike(a, b)
        return np.where(good, prose * (1 - density), 0.0)


def _weigh(nodes: list[dict], paragraphs: list[dict], broken: str, floor: int) -> None:
    """Gives every candidate block its weight: how much of it reads as prose, less its share of links; 0 if that is too
    little, too linked, or an index, most of whose lines open alike. Two paragraphs or more count, otherwise lines."""
    blocks = [n for n in nodes if n["tag"] in CANDIDATES]
    if not blocks:
        return
    pre, end = (np.array([n[k] for n in blocks], dtype=np.int64) for k in ("pre", "end"))
    links = [n for n in nodes if n["tag"] == "a"]
    long = np.array([0, *accumulate(len(n["text"].strip()) for n in links)], dtype=np.int64)
    at = np.array([n["pre"] for n in links], dtype=np.int64)
    linked = long[np.searchsorted(at, end)] - long[np.searchsorted(at, pre)]
    by_p, at = _Lines([p["text"] for p in paragraphs]), np.array([p["pre"] for p in paragraphs], dtype=np.int64)
    p0, p1 = np.searchsorted(at, pre), np.searchsorted(at, end)
    # lines that lie wholly within a block, and what of a line it begins or ends in
    raw = broken.split("\n")
    lines = [normalized(x) for x in raw]
    begins = np.array([0, *accumulate(len(x) + 1 for x in raw)], dtype=np.int64)
    by_line = _Lines(lines)
    b0, b1 = (np.array([n[k] for n in blocks], dtype=np.int64) for k in ("from", "upto"))
    l0, l1 = np.searchsorted(begins[:-1], b0), np.searchsorted(begins[1:] - 1, b1, side="right")
    own = np.maximum(l1, l0)
    weight = np.where(p1 - p0 >= 2, by_p.weights(p0, p1, linked, floor), by_line.weights(l0, own, linked, floor))
    for k in np.flatnonzero((p1 - p0 < 2) & ((begins[l0] != b0) | (begins[own] - 1 != b1))).tolist():
        ends = [broken[b0[k] : b1[k]]] if l1[k] < l0[k] else [broken[b0[k] : max(b0[k], begins[l0[k]] - 1)], broken[min(begins[l1[k]], b1[k]) : b1[k]]]
        head, tail = normalized(ends[0]), normalized(ends[-1]) if len(ends) > 1 else ""
        if head or tail:  # such lines are rare: blocks mostly begin and end with a line
            some = _Lines([head, *lines[l0[k] : own[k]], tail])
            weight[k] = some.weights(np.array([0]), np.array([some.count - 1]), linked[k : k + 1], floor)[0]
    for n, w in zip(blocks, weight.tolist(), strict=True):
        n["weight"] = w


def resolved(url: str | None, href: str) -> str:
    try:
        return urljoin(url or "", href)
    except ValueError:
        return href


def read_tree(html: str | None, noise: tuple[str, ...] = (), floor: int | None = None, url: str | None = None) -> dict:
    """nodes, paragraphs (the text of each p that has any) and the line-broken text of a page, without elements of noise."""
    parser = _Parser(noise)
    parser.feed(html or "")
    parser.close()
    parser.shut(0)
    plain, broken = "".join(parser.plain), "".join(parser.broken)
    for node in parser.nodes:
        node["text"] = plain[node["c0"] : node["c1"]] if node["tag"] in _TOLD else None
        node["link"] = resolved(url, node["href"]) if node["href"] is not None else None
    paragraphs = [{"pre": n["pre"], "text": t} for n in parser.nodes if n["tag"] == "p" and (t := normalized(plain[n["c0"] : n["c1"]]))]
    if floor is not None:
        _weigh(parser.nodes, paragraphs, broken, floor)
    return {"nodes": parser.nodes, "paragraphs": paragraphs, "broken": broken}


def with_tree(pages: DataFrame, noise: tuple[str, ...] = (), floor: int | None = None) -> DataFrame:
    """pages (html and others) with tree: nodes, paragraphs and the line-broken text; null html is an empty page. Links of
    nodes are resolved against the page's url, if there is one.

    floor: characters of prose that a block needs for a weight; without it none is weighed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            rest = [c for c in batch.schema.names if c != "tree"]
            urls = batch["url"].to_pylist() if "url" in batch.schema.names else [None] * batch.num_rows
            found = [read_tree(h, noise, floor, u) for h, u in zip(batch["html"].to_pylist(), urls, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(found, _TREE)], [*rest, "tree"])

    pages = pages.drop("tree")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(run, f"{schema}, tree {_SCHEMA}")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _matches(node: Column, step: str) -> Column:
    """Whether an element fits one step of a selector: a tag, #id, .class and [name=value] in any number."""
    parts = re.findall(r"\[(rel|href)(?:=\"?([^\]\"]*)\"?)?\]|([#.]?)([\w-]+)", step)
    fits = F.lit(True)
    for name, value, mark, word in parts:
        if name:
            fits = fits & (node[name] == value if value else node[name].isNotNull())
        else:
            fits = fits & (node["id"] == word if mark == "#" else F.array_contains(node["classes"], word) if mark == "." else node["tag"] == word)
    return F.coalesce(fits, F.lit(False))


def find(nodes: Column, selector: str, within: Column | None = None) -> Column:
    """The elements that a selector of descendant steps fits, in document order; those within an element, if one is given.

    Each step filters all elements once, by the few that fit the step before.
    """
    first, *steps = selector.split()
    found = F.filter(nodes, lambda n: _matches(n, first))
    for step in steps:
        inside = lambda step: lambda above: F.filter(nodes, lambda n: _matches(n, step) & F.exists(above, lambda a: (n["pre"] > a["pre"]) & (n["pre"] < a["end"])))
        found = bound(found, inside(step))
    return found if within is None else bound(within, lambda w: F.filter(found, lambda n: (n["pre"] > w["pre"]) & (n["pre"] < w["end"])))


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def paragraphs_within(tree: Column, node: Column, but: Column | None = None) -> Column:
    """The texts of the paragraphs within an element, but for those within any of some others."""
    own = lambda p, n: (p["pre"] > n["pre"]) & (p["pre"] < n["end"])
    kept = F.filter(tree["paragraphs"], lambda p: own(p, node) & ~F.exists(but, lambda b: own(p, b)) if but is not None else own(p, node))
    return F.transform(kept, lambda p: p["text"])


def lines_within(tree: Column, node: Column) -> Column:
    """The lines of an element: <br>, <p> and <div> break them, as do line ends of the page."""
    text = F.substring(tree["broken"], node["from"] + 1, node["upto"] - node["from"])
    plain = F.transform(F.split(text, "\n"), lambda x: stripped(F.translate(x, " 　", "  ")))
    return F.filter(plain, lambda x: x != "")


def chapter_lines(tree: Column, node: Column) -> Column:
    """Two paragraphs or more, otherwise lines, if they are more."""
    return bound(paragraphs_within(tree, node), lambda ps: F.when(F.size(ps) >= 2, ps).otherwise(bound(lines_within(tree, node), lambda ls: F.when(F.size(ls) > F.size(ps), ls).otherwise(ps))))


def densest(nodes: Column, share: float = 0.95) -> Column:
    """The block of most weight, or the deepest within it that keeps `share` of that; null where none has any."""
    weighed = F.filter(nodes, lambda n: n["weight"] > 0)
    rank = lambda n, by: F.struct(by, (-n["pre"]).alias("early"), n.alias("n"))
    top = lambda ns, by: F.array_max(F.transform(ns, lambda n: rank(n, by(n).alias("by"))))["n"]

    def deepest(ns: Column) -> Column:
        best = top(ns, lambda n: n["weight"])
        near = lambda b: F.filter(ns, lambda n: (n["weight"] >= share * b["weight"]) & (n["pre"] >= b["pre"]) & (n["pre"] < b["end"]))
        return bound(best, lambda b: top(near(b), lambda n: n["depth"]))

    return bound(weighed, deepest)
