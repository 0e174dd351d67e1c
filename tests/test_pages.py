"""Trees of pages, the chapter of unknown pages, and readers of known sites."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quirefold.plans import catalog
from quirefold.sources import pages as p
from quirefold.sources import sites, tree

D = "/root/testdata/sf0.001"
PROSE = [
    "The lamp went out twice before the old door opened, and nobody inside came forward to meet the guest.",
    "It had rained since the third watch, and the stones of the yard were wet enough to bring a careless guard down.",
    "She counted the marks on the letter again, hoping that the number would change, and it did not.",
    "Far below the terrace a bell rang once, which meant that the gates were shut for the night.",
    "They had told him the road would be empty at this hour, and whoever said so had never walked it.",
]
BREAKS = ["他抬頭看向夜空,什麼也沒有說,只是把手裡的燈又提高了一些,走了過去。", "院子裡的石板被雨水洗得發亮,走在上面要格外小心才不會滑倒的。", "遠處的鐘聲響了一下,那表示城門已經關上了,今夜誰也進不來。", "她把那封信上的印記數了一遍又一遍,數字始終沒有變過,一個也沒有。"]


def prose(n):
    return "".join(f"<p>{PROSE[i % len(PROSE)]}</p>" for i in range(n))


#: What the reader of unknown pages must do: page, floor, (title, paragraphs, next link, continues) or None.
CASES = {
    "the chapter, not what surrounds it": (f'<nav><a href="/">Home</a></nav><div id=w><div class=s><a href=/1>Chapter 1</a><a href=/2>Chapter 2</a></div><div class=c><h1>Chapter 7: The Gate</h1>{prose(4)}</div></div><div class=f><a href=/6>Previous</a><a href="/8">Next Chapter</a></div>', 200, ("Chapter 7: The Gate", PROSE[:4], "https://x.org/8", False)),
    "lines between breaks": (f'<title> T </title><div id=content>{"<br><br>".join(BREAKS)}</div><a id=next_url href=page2.html>下一页</a>', 100, ("T", BREAKS, "https://x.org/b/page2.html", True)),
    "next page before next chapter": (f"<div class=read>{prose(3)}</div><div><a href=/9>下一章</a><a href=/8_2>下一页</a></div>", 200, ("", PROSE[:3], "https://x.org/8_2", True)),
    "rel=next": (f'<article>{prose(3)}</article><a href=/0>next</a><a rel="next" href="/12">›</a>', 200, ("", PROSE[:3], "https://x.org/12", False)),
    "a class with next": (f'<article>{prose(3)}</article><a class="btn next-chapter" href="/13">»</a>', 200, ("", PROSE[:3], "https://x.org/13", False)),
    "words that merely hold next": (f'<article>{prose(3)}</article><a class="context-help" href="/help">About this</a>', 200, ("", PROSE[:3], None, False)),
    "words around next chapter": (f"<article>{prose(3)}</article><a href=/5>下一节 >></a>", 200, ("", PROSE[:3], "https://x.org/5", False)),
    "links within noise do not count": (f"<article>{prose(3)}</article><nav><a rel=next href=/n>x</a></nav><footer><a href=/m>next</a></footer><link rel=next href=/l>", 200, ("", PROSE[:3], None, False)),
    "a list of links": ("<div><a href=/1>Chapter 1</a><a href=/2>Chapter 2</a></div><div>Please log in to read on.</div>", 200, None),
    "an index in plain text": ("<div class=list>" + "".join(f"<div>The Very Long Book of Many Names Chapter {i}</div>" for i in range(40)) + "</div>", 200, None),
    "an index beside the chapter": ("<div class=list>" + "".join(f"<div>The Very Long Book of Many Names Chapter {i}</div>" for i in range(99)) + f"</div><div class=c>{prose(3)}</div>", 200, ("", PROSE[:3], None, False)),
    "too short": (f"<div>{prose(2)}</div>", 2000, None),
    "noise in the block": (f"<div><form><p>{PROSE[3]}</p></form><p>{PROSE[0]}</p><aside><p>{PROSE[4]}</p></aside><script>var x = '<p>no</p>';</script><p>{PROSE[1]}</p><button>{PROSE[2]}</button></div>", 100, ("", PROSE[:2], None, False)),
    "open noise ends with what holds it": (f"<div><nav><a href=/>Home</div><div><h2>H</h2>{prose(3)}</div>", 200, ("H", PROSE[:3], None, False)),
    "end tags left out": (f"<div><h3>H</h3><p>{PROSE[0]}<p>{PROSE[1]}<p>{PROSE[2]}</div>", 200, ("H", PROSE[:3], None, False)),
    "an empty page": ("", 200, None),
    "no page": (None, 200, None),
}


@pytest.mark.parametrize("floor", [100, 200, 2000])
def test_unknown_pages(spark, floor):
    cases = {k: v for k, v in CASES.items() if v[1] == floor}
    df = spark.createDataFrame([(k, f"<html><body>{v[0]}</body></html>" if v[0] is not None else None, "https://x.org/b/1") for k, v in cases.items()], "name string, html string, url string")
    got = {r.name: r.page and (r.page.title, r.page.paragraphs, r.page.next_url, r.page["continues"]) for r in p.extract(df, floor).collect()}
    assert got == {k: v[2] for k, v in cases.items()}


@pytest.mark.parametrize("html, n", [
    (f"<div><svg class=icon/>{prose(3)}</div>", 3), (f"<div><svg><path d=x/><g/></svg>{prose(3)}</div>", 3), (f"<div><svg><path d=x>{prose(3)}</div>", 3), (f"<div>{'</br>'.join(PROSE[:3])}</div>", 3), (f"<div>{'</p>'.join(PROSE[:3])}</div>", 3),
    (f"<div><span><div class=c>{PROSE[0]}</span><br>{PROSE[1]}<br>{PROSE[2]}</div></div>", 3), (f"<section><b><div class=c>{PROSE[0]}</b><br>{PROSE[1]}<br>{PROSE[2]}</div></section>", 3), (f"<div>{PROSE[0]}<br>{PROSE[1]}</body></html><br>{PROSE[2]}</div>", 3),
    (f"<div><table><tr><td>{PROSE[0]}</div><br>{PROSE[1]}<br>{PROSE[2]}</td></tr></table></div>", 3), (f"<div><p>{PROSE[0]}<nav>x</nav><p>{PROSE[1]}</p><p>{PROSE[2]}</p></div>", 3), (f"<div><nav><b>x</span></nav>{prose(3)}</div>", 3),
    (f"<div><svg><foreignObject><p>{PROSE[3]}</p></foreignObject></svg>{prose(2)}</div>", 2), (f"<div><iframe src=x></iframe>{prose(2)}<aside><p>{PROSE[3]}</p></div>", 2),
    (f"<section><a name=x><div class=c>{PROSE[0]}<br><a name=y></a>{'<br>'.join(PROSE[1:])}</div></section>", 5),
])
def test_no_line_of_the_block_is_left_out(spark, html, n):
    """On pages whose tags do not fit each other, as browsers read them."""
    got = sites.densest_block(spark.createDataFrame([(html,)], "html string"), 20).first()
    assert got.lines == PROSE[:n]


class Plain(HTMLParser):
    """A page as nested lists, by the same rules for end tags left out of p, for comparison."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["root", []]
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "div", "section", "article") and self.stack[-1][0] == "p":
            self.stack.pop()
        node = [tag, []]
        self.stack[-1][1].append(node)
        if tag != "br":
            self.stack.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def below(node):
    for x in node[1]:
        if isinstance(x, list):
            yield x
            yield from below(x)


def text(node):
    return "".join(x if isinstance(x, str) else text(x) for x in node[1])


def broken(node):
    own = "".join(x if isinstance(x, str) else broken(x) for x in node[1])
    return ("\n" if node[0] in ("br", "p", "div") else "") + own + ("\n" if node[0] in ("p", "div") else "")


def weight(node, floor):
    ps = [t for x in below(node) if x[0] == "p" and (t := tree.normalized(text(x)))]
    lines = [t for x in broken(node).split("\n") if (t := tree.normalized(x))]
    lines = ps if len(ps) >= 2 or len(lines) <= len(ps) else lines
    stems = [x[:10] for x in lines if len(x) >= 10]
    if len(lines) >= 4 and any(stems.count(s) >= 4 and stems.count(s) * 10 >= len(lines) * 6 for s in set(stems)):
        return 0.0
    good = [x for x in lines if len(x) >= 48 or (len(x) >= 24 and x[-1] in ".!?。")]
    total, linked = sum(map(len, lines)), sum(len(text(x).strip()) for x in below(node) if x[0] == "a")
    if len(good) < 2 or sum(map(len, good)) < floor or linked / total > 0.3:
        return 0.0
    return sum(map(len, good)) * (1 - linked / total)


def test_weights_equal_plain_recursion():
    r = random.Random(4)

    def page(depth):
        out = []
        for _ in range(r.randint(1, 5)):
            kind, line = r.choice(["p", "div", "section", "br", "a", "text", "article"]), r.choice([*PROSE, "Chapter number one", "x", "Chapter number one and some more words to make it long enough.", " "])
            if kind in ("div", "section", "article") and depth < 5:
                out.append(f"<{kind}>{page(depth + 1)}</{kind}>")
            else:
                out.append({"p": f"<p>{line}</p>", "br": f"{line}<br>", "a": "<a href=x>link</a>"}.get(kind, line + r.choice(["", "\n"])))
        return "".join(out)

    seen = 0
    for _ in range(400):
        html = page(0)
        plain = Plain()
        plain.feed(html)
        plain.close()
        want = [weight(n, 50) for n in below(plain.root) if n[0] in tree.CANDIDATES]
        got = [n["weight"] for n in tree.read_tree(html, floor=50)["nodes"] if n["tag"] in tree.CANDIDATES]
        assert len(got) == len(want) and all(abs(a - b) < 1e-6 for a, b in zip(got, want, strict=True)), html
        seen += sum(w > 0 for w in want)
    assert seen > 200


def test_a_large_page_takes_linear_time():
    line = "<div><p>{0} words that together make a sentence of prose, as it were.</p><a href=/{0}>link {0}</a></div>"
    pages = ["<div>" * 50 + "".join(line.format(i) for i in range(n)) + "</div>" * 50 for n in (3000, 12000)]
    assert len(pages[1]) > 1_000_000
    took = []
    for html in pages:
        began = time.perf_counter()
        assert max(n.get("weight") or 0 for n in tree.read_tree(html, tree.NOISE, 200)["nodes"]) > 0
        took.append(time.perf_counter() - began)
    assert took[1] < 2 * 4 * took[0] + 0.2 and took[1] < 6


def test_selectors(spark):
    html = '<div id=a class="x y"><p class=z>1</p><div class=y><p>2</p><a rel=next href=q>3</a></div></div><p>4</p><div class=y><p class="w z">5</p></div>'
    df = tree.with_tree(spark.createDataFrame([(html, "http://h/d/")], "html string, url string"))
    got = lambda s, within=None: [r for r in df.select(F.transform(tree.find(F.col("tree.nodes"), s, within), lambda n: n["pre"])).first()[0]]
    assert got("p") == [1, 3, 5, 7] and got("#a p") == [1, 3] and got("div.y") == [0, 2, 6] and got(".y .y p") == [3] and got("p.w.z") == [7] and got('a[rel="next"]') == [4] and got("a[href]") == [4] and got("[rel=other]") == []
    assert got("p", tree.first(tree.find(F.col("tree.nodes"), ".y .y"))) == [3] and got("#none p") == [] and got("p", tree.first(tree.find(F.col("tree.nodes"), "#none"))) in ([], None)
    assert df.select(tree.first(tree.find(F.col("tree.nodes"), "a"))["link"]).first()[0] == "http://h/d/q"


def test_known_sites(spark):
    rows = [
        ("https://a.org/1", f'<div id=article><h4> Ch. 1 </h4><p>{PROSE[0]}</p><div class="reader-ad-skip"><p>AD</p></div><p> {PROSE[1]}</p>stray</div><a id=next_url href=/2>go</a>'), ("https://a.org/2", "<p>no holder</p>"), ("https://a.org/3", "<div id=article></div>"),
        ("https://m.b.org/1", f"<h1>Site</h1><h1 class=headline>T</h1><div class='x content'><h1>not here</h1><p>{PROSE[0]}</p>loose<p>请大家收藏 us</p><p>温馨提示: stays</p></div><a href=/0>上一页</a><a href=/1_2>下一页</a><a href=/2>下一章</a>"),
        ("https://m.b.org/2", "<div class=content><p>x</p></div><a>下一章</a><a href=/3>下一章</a>"),
        ("https://www.c.org/1", f"<a href=wrong>下一章</a><div id=chapterWarp><div class=chapter-content><h1>T (2 / 3)</h1><p>outside</p><div class=content><p>温馨提示: y</p><p>{PROSE[1]}</p><p>本章完 stays</p></div></div></div><div class=foot-nav><a href=0>目錄</a><a href=3>下一章</a></div>"),
        ("https://c.org/2", "<div id=chapterWarp><div class=chapter-content><h1>T</h1><div class=content><p> </p></div></div></div>"), ("https://c.org/3", "<div class=chapter-content><h1>T</h1><div class=content><p>x</p></div></div>"), ("https://d.org/1", "x"), ("https://a.org/4", None),
    ]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {r.url: (r.title, r.text, r.next_url, r["continues"]) for r in sites.read_pages(df, {"a.org": "article", "b.org": "content", "c.org": "wrapped"}).collect()}
    assert got == {
        "https://a.org/1": ("Ch. 1", f"{PROSE[0]}\n\n{PROSE[1]}", "https://a.org/2", False), "https://a.org/3": ("", "", None, False), "https://m.b.org/1": ("T", f"{PROSE[0]}\n\n温馨提示: stays", "https://m.b.org/1_2", True),
        "https://m.b.org/2": ("", "x", None, False), "https://www.c.org/1": ("T", f"{PROSE[1]}\n\n本章完 stays", "https://www.c.org/3", True),
    }


def test_page_queries(spark):
    """The queries over the table of pages: each page's block has the most weight that plain recursion finds."""
    html = {r.page_id: r.html for r in spark.read.parquet(f"{D}/pages.parquet").collect()}
    got = {r.page_id: r.n_lines for r in catalog.QUERIES["t24_t25_densest_block"](spark, D).collect()}
    assert set(got) == set(html) and sum(n is not None for n in got.values()) > len(got) // 2
    for k, h in html.items():
        weights = [n["weight"] for n in tree.read_tree(h, tree.NOISE, 20)["nodes"] if n["tag"] in tree.CANDIDATES]
        assert (got[k] is not None) == (max(weights, default=0) > 0)
    pages = {r.page_id: r for r in catalog.QUERIES["a10_extract_pages"](spark, D).collect()}
    assert set(pages) == set(html) and sum(r.title is not None for r in pages.values()) > len(html) // 2
    assert catalog.QUERIES["a14_preview"](spark, D).count() == sum(r.title is not None for r in pages.values())
    read = catalog.QUERIES["a06_a09_site_pages"](spark, D).collect()
    assert {r.page_id % 4 for r in read} == {0, 1, 2} and all(r.title.startswith("T") and r.next_url for r in read)
