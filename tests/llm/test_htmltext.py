import html
import math
import random
import re

import pytest

from rillmark.llm import htmltext
from rillmark.llm.htmltext import main_text
from rillmark.llm.queries import QUERIES


def test_articles_of_all_pages(spark, small):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    found = QUERIES["op6_main_text"](spark, small).collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", article)
        plain = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b\b[^>]*>", "", b))).split()) for b in blocks]
        assert r["text"] == "\n\n".join(b for b in plain if b) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


LONG = "A sentence of the main text that goes on for a while, with commas and all. " * 4


@pytest.mark.parametrize(
    "around",
    [
        "<nav><a href=/>Home</a> <a href=/n>News</a></nav>{}<footer>&copy; all rights reserved by us</footer>",
        '<div id="header"><a>Home</a></div><div class="wrap"><div class="side-bar sidebar"><ul><li><a>one</a><li><a>two</a></ul></div>{}</div><div id=footer>Imprint</div>',
        '<div><form action="/s"><label>Search</label><input name=q><button>Go</button></form></div>{}<script>if (a<b) document.write("<p>no</p>")</script>',
        '<aside><p>Related: something else to read</p></aside>{}<section class="comments"><h3>Comments</h3><p>I do not agree at all with this, said a reader.</p></section>',
        '{}<section id="comments"><article class="comment"><p>A reader writes this at some length, and more than once or twice.</p></article></section>',
        '<div class="cookie-notice"><p>We use cookies and so on, please accept them.</p></div>{}<style>p > a {{color: red}}</style><!-- <p>hidden</p> -->',
        '<div role="banner">Site</div><div hidden><p>Not shown to anyone who reads</p></div>{}<noscript>Turn it on</noscript>',
        "<header><h2>The site's name and motto</h2></header>{}<template><p>Later</p></template>",
    ],
)
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>'])
def test_what_stands_around_the_text_is_left_out(around, inner):
    body = f"<h1>Title &amp; more</h1><p>{LONG}</p><p>{LONG}<p>Short. &lt;b&gt;</p><ul><li>{LONG}</li></ul><p>{LONG}</p>"
    page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + around.format(inner.format(body)) + "</body></html>"
    line = " ".join(LONG.split())
    assert main_text(page) == "\n\n".join(["Title & more", line, line, "Short. <b>", line, line])


@pytest.mark.parametrize(
    "attributes",
    [
        ' data-title="Hidden figures"', " title='what hidden, style=display:none'", ' href="/hidden-lake"', " href=/a/hidden", ' href="/post?id=login"', ' data-role="search"', ' data-class="sidebar" data-id=nav',
        ' alt = "role=navigation"', ' lang="en"data-hidden', " x-hidden y-style='display:none'",
    ],
)
def test_only_whole_names_of_attributes_count(attributes):
    line = " ".join(LONG.split())
    for tag in ("article", "p", "section"):
        assert main_text(f"<article><p>{LONG}</p><{tag}{attributes}>{LONG}</{tag}><p>{LONG}</p></article>") == "\n\n".join([line] * 3)
    assert main_text(f"<article><p>{LONG} <a{attributes}>link text</a> {LONG}</p></article>") == f"{line} link text {line}"


@pytest.mark.parametrize("attributes", [" hidden", " HIDDEN=''", ' title="a b" hidden', ' a=1 aria-hidden = "true"', " style='color:red; display : none'", ' title="x"class="sidebar"', " data-a='x' role=search", " id=nav"])
def test_attributes_that_leave_an_element_out(attributes):
    line = " ".join(LONG.split())
    assert main_text(f"<article><p>{LONG}</p><div{attributes}>Something else</div><p>{LONG}</p></article>") == f"{line}\n\n{line}"


@pytest.mark.parametrize("main", ["article", "main"])
def test_dense_text_beside_an_article_that_holds_the_densest_node(main):
    line = " ".join(LONG.split())
    inner = f"<{main}><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></{main}>"
    little = "<div><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div>{}<div><p>Made by the company of this site.</p></div>"
    assert main_text(f"<div><p>Lead. {LONG}</p>{inner}<p>Tail. {LONG}</p></div>") == "\n\n".join([f"Lead. {line}", line, line, line, f"Tail. {line}"])
    assert main_text(little.format(f"<div><p>Lead. {LONG}</p>{inner}</div>")) == "\n\n".join([f"Lead. {line}", line, line, line])
    assert main_text(little.format(inner)) == "\n\n".join([line] * 3)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("   \n", ""), ("<html><body></body></html>", ""), ("just text &amp; <b>more</b>", "just text & more"),
        ("<p>a<p>b<!-- x", "a\n\nb"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<div>" * 20000 + "deep", "deep"), ("<p>x</b></div></p>y</p>", "x\n\ny"),
        ("<p>a&nbsp;\t b<br>c &#233;&#xe9;</p>", "a b c éé"), ("<script>var a = '<p>no</p>'", ""), ('<p title="a > b">t</p>', "t"), ("<P>Up</P><p>low<a href='x>t</p>", "Up\n\nlowt"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"), ("&amp;lt;", "&lt;"), ("<svg><text>no</text></svg>yes", "yes"),
    ],
)
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_nulls_repeats_empty_table_and_clashing_columns(spark):
    from rillmark.llm.htmltext import extract

    made = spark.createDataFrame([(1, None, "<p>a</p>"), (None, "u", None), (1, None, "<p>a</p>")], "page_id long, url string, html string")
    made = made.selectExpr("*", "'x' as text", "'y' as HTML", "0 as n_chars").toDF("page_id", "url", "html", "text", "HTML", "n_chars")
    assert sorted(((r["page_id"] or 0, r["url"] or "", r["text"]) for r in extract(made).collect())) == [(0, "u", ""), (1, "", "a"), (1, "", "a")]
    assert extract(made.filter("false")).count() == 0


def _tree(rng, depth=0):
    """(tag, [text or tree, ...]) at random."""
    tag = rng.choice(["div", "section", "p", "a", "span", "b"]) if depth else "body"
    parts = []
    for _ in range(rng.randrange(1, 5)):
        if depth < 4 and tag in ("body", "div", "section") and rng.random() < 0.6:
            parts.append(_tree(rng, depth + 1))
        else:
            parts.append("x" * rng.randrange(1, 60))
    return tag, parts


def _html(tree):
    return f"<{tree[0]}>" + "".join(x if isinstance(x, str) else _html(x) for x in tree[1]) + f"</{tree[0]}>"


def _figures(tree):
    """[(tag, characters, tags, link characters, link tags, children)] in page order, by recursion."""
    tag, parts = tree
    inner = [_figures(x) for x in parts if not isinstance(x, str)]
    own = sum(len(x) for x in parts if isinstance(x, str))
    tops = [f[0] for f in inner]
    chars, tags = own + sum(f[1] for f in tops), sum(f[2] + 1 for f in tops)
    linked, links = sum(f[3] for f in tops), sum(f[4] for f in tops)
    if tag == "a":
        linked, links = chars, links + 1
    return [(tag, chars, tags, linked, links, tops), *[f for one in inner for f in one]]


def test_densities_and_their_sums_by_recursion():
    rng = random.Random(5)
    for _ in range(200):
        tree = _tree(rng)
        figures = _figures(tree)
        page = htmltext.Page(_html(tree))
        body = figures[0]

        def density(f):
            _, c, t, lc, lt, _ = f
            if not c:
                return 0.0
            # C / T * log(C / LC * T / LT) to the base ln(C / (C - LC) * LC + LC_b / C_b * C + e)
            ratio = (c / max(1, lc)) * (max(1, t) / max(1, lt))
            base = math.log(c / max(1, c - lc) * lc + body[3] / max(1, body[1]) * c + math.e)  # noqa: B023
            power = math.log(ratio) / math.log(base) if base > 1 + 1e-9 else math.log(ratio)
            return c / max(1, t) * max(0.0, power)

        chars, tags, found, total = page.densities([False] * len(page.tag))
        assert page.tag == [f[0] for f in figures] and chars == [f[1] for f in figures] and tags == [f[2] for f in figures]
        assert found == pytest.approx([density(f) for f in figures])
        assert total == pytest.approx([sum(map(density, f[5])) for f in figures])


def test_densest_sum_and_threshold_choose_the_blocks():
    """Without marks of any kind: the densest sum's node, and what beside its path is as dense as the path's least."""
    long, links = "Plain words of the story. " * 12, "".join(f"<li><a href='/{k}'>go {k}</a></li>" for k in range(30))
    story = "".join(f"<p>{k} {long}</p>" for k in range(5))
    page = htmltext.Page(f"<div><ul>{links}</ul></div><div><div>{story}</div><div>{long}</div></div><div><ul>{links}</ul></div>")
    chars, tags, density, total = page.densities([False] * len(page.tag))
    best = max(range(len(total)), key=lambda i: total[i])
    assert [page.tag[i] for i in range(len(page.tag)) if page.parent[i] == best] == ["p"] * 5
    path, i = [], best
    while i >= 0:
        path.append(i)
        i = page.parent[i]
    least = min(density[i] for i in path)
    beside = [i for i in range(len(page.tag)) if page.parent[i] in path and i not in path]
    assert {i for i in beside if density[i] < least} == {i for i in beside if page.tag[i] == "div" and tags[i] > 10}
    assert page.text().split("\n\n") == [f"{k} {long}".strip() for k in range(5)] + [long.strip()]
