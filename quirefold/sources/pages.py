"""Web pages: title, chapter text and next link of pages of unknown sites, previews, robots rules."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.functions.text import bound, cjk_share, title_part
from quirefold.sources import tree

#: Words of links to the next page of a chapter and to the next chapter.
NEXT_PAGE, NEXT_CHAPTER = ("下一页", "下一頁", "next page"), ("下一章", "下一節", "下一节", "next chapter", "next")


def next_link(nodes: Column) -> Column:
    """url and continues (the chapter goes on there): an `a` with rel=next, else the first link whose words hold those for a
    next page, else for a next chapter, else one with `next` between spaces, - and _ in its id or class; null if none."""
    words = lambda n: F.lower(tree.stripped(F.translate(n["text"], "\u00a0\u3000", "  ")))
    holds = lambda n, some: F.exists(F.array(*map(F.lit, some)), lambda w: F.contains(words(n), w))
    tokens = lambda n: F.split(F.lower(F.concat_ws(" ", F.array(F.coalesce(n["id"], F.lit(""))), n["classes"])), "[ _-]")
    first = lambda links, continues: bound(tree.first(links), lambda n: F.when(n["href"].isNotNull(), F.struct(n["link"].alias("url"), F.lit(continues).alias("continues"))))

    def chosen(links: Column) -> Column:
        some = F.filter(links, lambda n: F.coalesce(n["href"], F.lit("")) != "")
        return F.coalesce(
            first(F.filter(links, lambda n: n["rel"] == "next"), False), first(F.filter(some, lambda n: holds(n, NEXT_PAGE)), True),
            first(F.filter(some, lambda n: holds(n, NEXT_CHAPTER)), False), first(F.filter(some, lambda n: F.array_contains(tokens(n), "next")), False),
        )

    return bound(tree.find(nodes, "a"), chosen)


def _title(nodes: Column, within: Column) -> Column:
    """The first heading of the block that has text, by level, else the page's first h1, h2 or title."""
    plain = lambda n: tree.stripped(F.translate(n["text"], "\u00a0\u3000", "  "))
    told = [plain(tree.first(tree.find(nodes, tag, within))) for tag in ("h1", "h2", "h3", "h4")] + [plain(tree.first(tree.find(nodes, tag))) for tag in ("h1", "h2", "title")]
    return F.coalesce(*(F.when(x != "", x) for x in told), F.lit(""))


def extract(pages: DataFrame, floor: int = 200) -> DataFrame:
    """pages (url, html and others) with page: title, paragraphs, next_url, continues; null where a page is no chapter.

    Elements of noise go first. The chapter is the block with the most prose, or the deepest within it that keeps nearly all
    of that; pages whose chapter has under `floor` characters are none.
    """
    read = tree.with_tree(pages, tree.NOISE, floor)
    block, t = tree.densest(F.col("tree.nodes")), F.col("tree")

    def page(lines: Column, b: Column) -> Column:
        link = next_link(t["nodes"])
        told = bound(link, lambda x: F.struct(_title(t["nodes"], b).alias("title"), lines.alias("paragraphs"), x["url"].alias("next_url"), F.coalesce(x["continues"], F.lit(False)).alias("continues")))
        return F.when(F.length(F.array_join(lines, "\n\n")) >= floor, told)

    read = read.withColumn("_block", block)
    found = bound(tree.chapter_lines(t, F.col("_block")), lambda lines: page(lines, F.col("_block")))
    return read.withColumn("page", F.when(F.col("_block").isNotNull(), found)).drop("tree", "_block")


def preview(pages: DataFrame) -> DataFrame:
    """page_id, host, title, excerpt (320 characters), text_chars, paragraphs (1 at least), next_url, continues (does the
    title count further parts, or is the link to a next page) and suggested_mode of extracted pages that are chapters.
    """
    pages = pages.where("page is not null")
    text = F.array_join("page.paragraphs", "\n\n")
    part = title_part(F.col("page.title"))
    return pages.select(
        "page_id", F.parse_url("url", F.lit("HOST")).alias("host"), part["title"].alias("title"), F.substring(text, 1, 320).alias("excerpt"), F.length(text).cast("long").alias("text_chars"),
        F.greatest(F.lit(1), F.size("page.paragraphs")).cast("long").alias("paragraphs"), "page.next_url", (F.col("page.continues") | part["continues"]).alias("continues"), F.when(cjk_share(text) > 0.2, "translate").otherwise("bootstrap").alias("suggested_mode"),
    )


def _own_group(files: DataFrame) -> DataFrame:
    """host, key, value and pos of the lines in the groups for all agents of robots files (host, body)."""
    lines = files.select("host", F.posexplode(F.split("body", "\r?\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    lines = lines.withColumn("key", F.lower(F.trim(F.substring_index("line", ":", 1)))).withColumn("value", F.trim(F.regexp_replace("line", "^[^:]*:", "")))
    w = W.partitionBy("host").orderBy("pos")
    agent = F.last(F.when(F.col("key") == "user-agent", F.col("value")), ignorenulls=True).over(w)
    return lines.withColumn("agent", agent).where("agent = '*' and value != ''").select("host", "key", "value", "pos")


def robots_rules(files: DataFrame) -> DataFrame:
    """host, disallow: the path prefixes of the group for all agents. files: host, body."""
    return _own_group(files).where("key = 'disallow'").select("host", F.col("value").alias("disallow"))


def crawl_delays(files: DataFrame) -> DataFrame:
    """host, delay: the seconds between requests that the group for all agents asks for, the last number given; hosts that
    give none are left out."""
    asked = _own_group(files).where("key = 'crawl-delay'").withColumn("delay", F.col("value").try_cast("double")).where("delay >= 0")
    return asked.groupBy("host").agg(F.max_by("delay", "pos").alias("delay"))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path) that no rule of their host forbids; a host without rules forbids nothing."""
    return urls.join(rules.withColumnRenamed("host", "_h"), (F.col("host") == F.col("_h")) & F.col("path").startswith(F.col("disallow")), "left_anti")
