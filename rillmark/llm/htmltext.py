"""Main text of web pages by composite text density.

Each page's tags are read into a tree.  A node's density is its characters per tag,
adjusted by its links:

    C / T * log(C / LC * T / LT) to the base ln(C / (C - LC) * LC + LC_b / C_b * C + e)

with characters C, tags T, link characters LC and link tags LT (each 1 at least)
and b the body.  Of every node the densities of its children are summed; the node
of the greatest sum is the main text (or the article or main element around it),
and the least density on its path from the body is the threshold at which other
subtrees beside the path are taken as well, each at its node of the greatest sum.
Where an article or main element was taken around a denser node, those beside it
must be such elements themselves or have as many characters per tag.

Elements that never are main text are left out before: by their tag, their role,
or words of their class and id, the latter two only while they hold no article and,
on pages that mark none, less than half of the text.

Defined cases: a null or empty page has no text; broken markup is read as browsers
do in the common cases (implied ends, stray ends, open comments); text without any
tags is one block; pages of any size and depth are read without recursion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>|[!?][^>]*>)""", re.S)
#: Name and value of an attribute; a value is read whole, so that nothing in it counts as a name.
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
_WORD = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their end tag, and never main text.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes template svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
#: Inline cells that part words.
_SPACED = frozenset("br td th wbr option".split())
_NEVER = frozenset("head nav footer aside noscript button select input object canvas audio video dialog menu".split()) | _RAW
_GUARDED = frozenset(["form", "fieldset"])
_MAIN = frozenset(["article", "main"])
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " masthead footer comment comments disqus replies respond cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe"
    " signup social share sharing related recommended recommendations widget toolbar pagination pager login search copyright disclaimer".split()
)
#: Classes of articles that are not the main one.
_OTHERS = frozenset("comment comments reply related recommended teaser promo ad advert advertisement sponsored".split())
#: A start tag ends these open elements, up to the listed bounds.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_CLOSES |= {"tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Page:
    """The tree of a page: parallel lists by node number, parents before children, and the text in page order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.maybe, self.never = ["body"], [-1], [False], [False]
        #: (node, text), or (node, None) where a block starts or ends
        self.flow: list[tuple[int, str | None]] = []
        self._read(html)

    def _start(self, name: str, more: str) -> int:
        never, maybe = name in _NEVER, name in _GUARDED
        if name == "header":
            never = not any(t in _MAIN for t in self._open_tags())
        if more and not more.isspace():
            for key, value in _ATTRIBUTE.findall(more):
                key, value = key.lower(), value.strip("\"'").lower()
                if key in ("class", "id"):
                    # an article's own classes tell more than what it is ("comments-open"), so whole names count there
                    maybe |= not (_OTHERS.isdisjoint(value.split()) if name in _MAIN else _HINTS.isdisjoint(_WORD.findall(value)))
                elif key == "role":
                    maybe |= value in _ROLES
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                    never = True
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        self.maybe.append(maybe)
        self.never.append(never)
        return len(self.tag) - 1

    def _open_tags(self) -> Iterator[str]:
        return (self.tag[n] for n in self.stack)

    def _close(self, names: set[str], bounds: set[str]) -> None:
        """End the innermost open element of `names`, if no open element of `bounds` is further in."""
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[depth]]
            if name in names:
                del self.stack[depth:]
                return
            if name in bounds:
                return

    def _read(self, html: str) -> None:
        self.stack = [0]
        at, flow = 0, self.flow
        for_raw = {}
        while m := _TAG.search(html, at):
            if m.start() > at:
                flow.append((self.stack[-1], html[at : m.start()]))
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if m["end"]:
                bounds = set() if name in _BLOCK else _BLOCK
                if name not in ("body", "html"):
                    self._close({name}, bounds)
                if name in _BLOCK:
                    flow.append((self.stack[-1], None))
                continue
            if name in ("html", "body"):
                continue
            if name in _BLOCK:
                self._close({"p"}, {"table", "td", "th", "button", "object"})
                flow.append((self.stack[-1], None))
            elif name in _SPACED:
                flow.append((self.stack[-1], " "))
            if name in _CLOSES:
                self._close(*_CLOSES[name])
                if name == "tr":
                    self._close({"tr"}, {"table"})
            if name in _VOID:
                if name != "br":
                    self._start(name, "")
                continue
            node = self._start(name, m["more"])
            if name in _RAW:
                end = for_raw.setdefault(name, re.compile(rf"</{name}\s*>", re.I)).search(html, at)
                at = end.end() if end else len(html)
                continue
            self.stack.append(node)
        if at < len(html):
            flow.append((self.stack[-1], html[at:]))

    def _counted(self, out: list[bool]) -> tuple[list[int], ...]:
        """Characters, link characters, tags and link tags of every node, without what is left out."""
        n = len(self.tag)
        chars, linked, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.flow:
            if text and not out[node]:
                chars[node] += len(text.strip())
        for i in range(n - 1, 0, -1):
            if out[i]:
                continue
            if self.tag[i] == "a":
                linked[i], links[i] = chars[i], links[i] + 1
            p = self.parent[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            tags[p] += tags[i] + 1
            links[p] += links[i]
        return chars, linked, tags, links

    def densities(self, out: list[bool]) -> tuple[list, ...]:
        """Characters, tags, composite text density, and sum of the children's densities of every node, without what is left out."""
        n = len(self.tag)
        chars, linked, tags, links = self._counted(out)
        density, total = [0.0] * n, [0.0] * n
        share = linked[0] / max(1, chars[0])
        for i in range(n - 1, -1, -1):
            if out[i] or not chars[i]:
                continue
            c, t, lc, lt = chars[i], max(1, tags[i]), max(1, linked[i]), max(1, links[i])
            base = log(c / max(1, c - linked[i]) * linked[i] + share * c + e)
            density[i] = c / t * max(0.0, log(c / lc * t / lt)) / (log(base) if base > 1 + 1e-9 else 1.0)
            if i:
                total[self.parent[i]] += density[i]
        return chars, tags, density, total

    def text(self) -> str:
        n = len(self.tag)
        out = self.never[:]
        for i in range(1, n):
            out[i] = out[i] or out[self.parent[i]]
        whole = self._counted(out)[0]
        holds = [t in _MAIN and not m for t, m in zip(self.tag, self.maybe, strict=True)]
        for i in range(n - 1, 0, -1):
            holds[self.parent[i]] |= holds[i]
        told = any(whole[i] and self.tag[i] in _MAIN and not self.maybe[i] and not out[i] for i in range(1, n))
        for i in range(1, n):
            out[i] = out[i] or out[self.parent[i]] or (self.maybe[i] and not holds[i] and (told or 2 * whole[i] < whole[0]))
        chars, tags, density, total = self.densities(out)
        if not chars[0]:
            return ""
        best = max((i for i in range(n) if not out[i]), key=lambda i: (total[i], density[i], -i))
        path = [best]
        while path[-1]:
            path.append(self.parent[path[-1]])
        least = min(density[i] for i in path)
        main = next((i for i in path if self.tag[i] in _MAIN), best)
        chosen = {main}
        # greatest sum below each node
        top = list(range(n))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if not out[i] and total[top[i]] > total[top[p]]:
                top[p] = top[i]
        on_path = set(path)
        # beside a marked element around the densest node: other such elements, and what has as many characters a tag
        full = [main == best or self.tag[i] in _MAIN or chars[i] * max(1, tags[main]) >= chars[main] * max(1, tags[i]) for i in range(n)]
        for i in range(1, n):
            if not out[i] and i not in on_path and self.parent[i] in on_path and density[i] >= max(least, 1e-9) and full[i]:
                chosen.add(top[i] if total[top[i]] > density[i] else i)
        taken = [i in chosen for i in range(n)]
        for i in range(1, n):
            taken[i] = (taken[i] or taken[self.parent[i]]) and not out[i]
        blocks, open_block = [], []
        for node, text in [*self.flow, (0, None)]:
            if text is None:
                if open_block and (block := " ".join("".join(open_block).split())):
                    blocks.append(block)
                open_block = []
            elif taken[node]:
                open_block.append(unescape(text) if "&" in text else text)
        return "\n\n".join(blocks)


def main_text(html: str | None) -> str:
    """Blocks of the main text, joined by empty lines."""
    return Page(html).text() if html else ""


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row."""
    plain = pick(pages, id_col, url_col, html_col).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [main_text(h) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(plain.dtypes)
    return plain.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op6_main_text(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
