"""Pages of known sites: which reader a host has, where its chapter stands, and what of it is no prose."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import bound, title_part
from quirefold.sources import tree

#: By reader, the selectors of the element that holds the chapter, of the title (in the holder or in the
#: page), of what is cut out, of what else a paragraph of the holder lies in, and of links to what comes next, with their words.
READERS = {
    "article": {"holder": "#article", "title": "h4", "title_in_holder": True, "cut": ".reader-ad-skip", "within": None, "next": "#next_url", "pages": (), "chapters": None},
    "content": {"holder": "div.content", "title": "h1.headline", "title_in_holder": False, "cut": None, "within": None, "next": "a", "pages": ("下一页",), "chapters": ("下一章",)},
    "wrapped": {"holder": "#chapterWarp .chapter-content", "title": "h1", "title_in_holder": True, "cut": None, "within": ".content", "next": ".foot-nav a", "pages": (), "chapters": ("下一章",)},
}
#: Texts that a paragraph of no prose holds on `content` pages, and those it begins with on `wrapped` ones.
HELD = ("请点击下一页继续阅读", "请大家收藏", "本章完")
BEGUN = ("溫馨提示:", "温馨提示:")


def is_nag(paragraph: Column) -> Column:
    """Holding a nag of the site."""
    return F.exists(F.array(*map(F.lit, HELD)), lambda x: F.contains(paragraph, x))


def is_notice(paragraph: Column) -> Column:
    """Beginning with a notice."""
    return F.exists(F.array(*map(F.lit, BEGUN)), lambda x: F.startswith(paragraph, x))


def is_boilerplate(paragraph: Column) -> Column:
    """Blank, a nag or a notice."""
    bare = tree.stripped(paragraph)
    return (bare == "") | is_nag(bare) | is_notice(bare)


def _read(t: Column, reader: str) -> Column:
    """title, paragraphs, next_url and next_page (whether that is the chapter's next page) by one reader; null without holder."""
    rule, nodes = READERS[reader], t["nodes"]
    boring = {"content": is_nag, "wrapped": is_notice}.get(reader)

    def told(holder: Column) -> Column:
        title = tree.stripped(F.coalesce(tree.first(tree.find(nodes, rule["title"], holder if rule["title_in_holder"] else None))["text"], F.lit("")))
        # the paragraphs of the holder, but for those within what is cut out
        places = lambda selector, within: F.transform(tree.find(nodes, selector, within), lambda n: F.struct(n["pre"].alias("pre"), n["end"].alias("end")))
        in_any = lambda p, some: F.exists(some, lambda x: (p["pre"] > x["pre"]) & (p["pre"] < x["end"]))
        own = F.filter(t["paragraphs"], lambda p: (p["pre"] > holder["pre"]) & (p["pre"] < holder["end"]))
        if rule["cut"]:
            own = bound(places(rule["cut"], holder), lambda some: F.filter(own, lambda p: ~in_any(p, some)))
        elif rule["within"]:
            own = bound(places(rule["within"], None), lambda some: F.filter(own, lambda p: in_any(p, some)))
        texts = F.filter(F.transform(own, lambda p: tree.stripped(p["text"])), lambda x: (x != "") & ~boring(x) if boring else x != "")
        links = tree.find(nodes, rule["next"])
        if rule["chapters"] is not None:
            links = F.filter(links, lambda n: tree.stripped(n["text"]).isin(*rule["pages"], *rule["chapters"]))
        link = bound(tree.first(links), lambda n: F.struct(n["link"].alias("url"), F.coalesce(tree.stripped(n["text"]).isin(*rule["pages"]) & n["link"].isNotNull() if rule["pages"] else F.lit(False), F.lit(False)).alias("page")))
        return bound(link, lambda x: F.struct(title.alias("title"), texts.alias("paragraphs"), x["url"].alias("next_url"), F.coalesce(x["page"], F.lit(False)).alias("next_page")))

    return bound(tree.first(tree.find(nodes, rule["holder"])), lambda holder: F.when(holder.isNotNull(), told(holder)))


def read_pages(pages: DataFrame, hosts: dict[str, str]) -> DataFrame:
    """pages (url, html and others) of known hosts with title, text, next_url and continues; others are left out.

    hosts: reader by host. Left out too are pages without the element that holds the chapter, and of the reader `wrapped`
    those without title or paragraphs. A page continues if it links to the chapter's next page, or, by `wrapped`, if its
    title counts further parts.
    """
    names = F.create_map(*(F.lit(x) for pair in hosts.items() for x in pair))
    known = pages.withColumn("_reader", F.try_element_at(names, F.regexp_replace(F.parse_url("url", F.lit("HOST")), r"^(?:www|m)\.", ""))).where("_reader is not null")
    read = tree.with_tree(known)
    page = F.coalesce(*(F.when(F.col("_reader") == r, _read(F.col("tree"), r)) for r in sorted(set(hosts.values()))))
    read = read.withColumn("_page", page).drop("tree").where("_page is not null")
    wrapped = F.col("_reader") == "wrapped"
    part = title_part(F.col("_page.title"))
    read = read.withColumn("_part", F.when(wrapped, part).otherwise(F.struct(F.col("_page.title").alias("title"), F.lit(False).alias("continues"))))
    read = read.where(~wrapped | ((F.col("_part.title") != "") & (F.size("_page.paragraphs") > 0)))
    rest = [c for c in pages.columns if c not in ("title", "text", "next_url", "continues")]
    return read.select(*rest, F.col("_part.title").alias("title"), F.array_join("_page.paragraphs", "\n\n").alias("text"), F.col("_page.next_url").alias("next_url"), (F.col("_page.next_page") | F.col("_part.continues")).alias("continues"))


def densest_block(pages: DataFrame, floor: int = 200, share: float = 0.95) -> DataFrame:
    """pages (html and others) with lines: those of the block with the most prose, or of the deepest block inside it that
    keeps `share` of its weight; null where no block has any.
    """
    read = tree.with_tree(pages, tree.NOISE, floor).withColumn("_block", tree.densest(F.col("tree.nodes"), share))
    return read.withColumn("lines", F.when(F.col("_block").isNotNull(), tree.chapter_lines(F.col("tree"), F.col("_block")))).drop("tree", "_block")


#: Kinds, attributes (with the kind that has them) and relations that a genre's facts are asked for.
PRESETS = {
    "fantasy": (("character", "house", "kingdom", "location", "magic_system"), (("title", "character"), ("allegiance", "character"), ("status", "character")), ("member_of", "ally", "enemy", "mentor", "family", "located_in")),
    "litrpg": (("character", "skill", "item", "quest", "guild"), (("level", "character"), ("class", "character"), ("stats", "character")), ("member_of", "ally", "enemy", "mentor", "family", "located_in")),
    "mystery": (("character", "suspect", "clue", "location", "organization"), (("suspicion", "suspect"), ("alibi", "suspect"), ("status", "character")), ("member_of", "ally", "enemy", "family", "located_in")),
    "romance": (("character", "family", "location", "organization"), (("relationship_status", "character"), ("occupation", "character")), ("family", "ally", "enemy", "located_in")),
    "xianxia": (("character", "sect", "realm", "technique", "artifact", "beast"), (("rank", "character"), ("status", "character"), ("affiliation", "character"), ("state", "sect")), ("member_of", "ally", "enemy", "mentor", "family", "located_in")),
}
GENERIC = (("character", "group", "location", "item"), (("status", "character"), ("role", "character")), ("member_of", "ally", "enemy", "located_in"))


def ontology(genre: Column) -> Column:
    """kinds, attributes (name and kind) and relations of a genre, or of none in particular."""

    def told(preset) -> Column:
        kinds, attributes, relations = preset
        return F.struct(F.array(*map(F.lit, kinds)).alias("kinds"), F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind")) for n, k in attributes)).alias("attributes"), F.array(*map(F.lit, relations)).alias("relations"))

    out = None
    for name, preset in PRESETS.items():
        out = F.when(genre == name, told(preset)) if out is None else out.when(genre == name, told(preset))
    return out.otherwise(told(GENERIC))
