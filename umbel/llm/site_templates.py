"""Main text of web pages: site templates are found per host and cut out.

Every page is parsed into elements. An element subtree is named by a hash of its
tags and text. Spark counts, per host, on how many different contents each subtree
stands; one that recurs across many is template and is deleted, whatever its tag.
What a page says of itself is used as well: elements of navigation, headers,
footers, sidebars, forms, scripts and the like are no text of the article, nor are
elements whose class, id or role says advert, notice, menu or comments.

Recurrence is counted over contents, not pages: copies of one article are one
content, so an article copied many times is no template. Inside an article only
containers are deleted for recurring, never its paragraphs, headings, lists or
tables.
"""

from __future__ import annotations

import hashlib
import re
import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A subtree outside an article is template from this many contents of its host, and this share of them.
LEAST_CONTENTS, LEAST_SHARE = 3, 0.02
# A container inside an article needs more.
INNER_CONTENTS, INNER_SHARE = 10, 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(
    "head title script style noscript template iframe object embed svg math canvas audio video nav footer aside "
    "form button select option datalist textarea input label fieldset dialog menu map".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figure figcaption table thead tbody tfoot tr td th ul ol dl".split())
# An opening tag that ends an open paragraph, as browsers do.
ENDS_P = BLOCKS - frozenset("body html caption td th tr tbody thead tfoot optgroup option legend".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}}
_BAD_WORDS = (
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets "
    "footer header masthead toolbar share sharing social related recommended newsletter subscribe subscription signup login paywall "
    "pagination pager skip hidden"
).split()
_HEADS = frozenset(("header", "masthead", "banner"))
_BAD = re.compile(r"(?:^|(?<=[\s_-]))(" + "|".join(_BAD_WORDS) + r")(?=$|[\s_-]|\d)", re.I)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|reply|replies)(?:$|[\s_-]|\d)", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "silent", "children", "article", "key")

    # silent: 0 text, 1 by a name that layouts also give to what holds the article, 2 for good.
    def __init__(self, tag: str, silent: int, article: bool):
        self.tag, self.silent, self.article = tag, silent, article
        self.children: list = []
        self.key = ""


def _silent(tag: str, attrs: list, article: bool) -> int:
    if tag in SILENT or (tag == "header" and not article):
        return 2
    if tag in ("html", "body", "main"):
        return 0
    soft = 0
    for name, value in attrs:
        if name in ("class", "id") and value:
            words = _CAMEL.sub("-", value)
            if _COMMENTS.search(words):
                return 2
            found = {m.lower() for m in _BAD.findall(words)}
            # The heading of an article may be called its header.
            if found - _HEADS if article else found:
                soft = 1
        if name == "role" and value and value.strip().lower() in _BAD_ROLES:
            return 2
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return 2
        if name == "style" and value and re.search(r"display\s*:\s*none", value, re.I):
            return 2
    return 0 if tag == "article" and not article else soft


class Page(HTMLParser):
    """A page as a tree of elements, with the ends that browsers add."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", 0, False)
        self.open = [self.root]

    def _close(self, depth: int) -> None:
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth].tag == "p":
                    self._close(depth)
                    break
                if self.open[depth].tag in BLOCKS:
                    break
        ends = SAME_LEVEL.get(tag)
        if ends:
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth].tag in ends:
                    self._close(depth)
                    break
                if self.open[depth].tag in HOLDS[tag]:
                    break
        here = self.open[-1]
        article = here.article or tag in ("article", "main") or any(n == "role" and v in ("main", "article") for n, v in attrs)
        node = Node(tag, _silent(tag, attrs, here.article), article)
        if tag in ("article", "main") and not node.silent:
            for outer in self.open:
                outer.silent = outer.silent if outer.silent == 2 else 0
        here.children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # A slash closes nothing but a void element in HTML.

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                self._close(depth)
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    page = Page()
    page.feed(html)
    # What is left unread at the end is a tag or reference cut off; of a reference the text stays.
    rest = page.rawdata
    page.rawdata = "" if rest.startswith("<") else rest
    page.close()
    return page.root


def name_subtrees(root: Node) -> list[Node]:
    """All elements in page order, each with the hash of its subtree."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    for node in reversed(order):
        parts = [c.key if isinstance(c, Node) else _SPACE.sub(" ", c).strip() for c in node.children]
        node.key = hashlib.md5("\x01".join([node.tag, *parts]).encode("utf-8", "surrogatepass")).hexdigest()[:16]
    return order[1:]


def blocks(root: Node, cut: frozenset[int], order: list[Node]) -> list[str]:
    """Text blocks outside silent and cut subtrees, in page order."""
    gone = {id(order[i]) for i in cut}
    out: list[str] = []
    parts: list[str] = []

    def end():
        text = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            out.append(text)

    # Depth-first without recursion: pages may nest very deeply.
    stack: list = [root]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            parts.append(item)
        elif item.silent or id(item) in gone:
            if item.tag in BLOCKS:
                end()
            else:
                parts.append(" ")
        elif item.tag == "br":
            parts.append(" ")
        else:
            if item.tag in BLOCKS:
                end()
                stack.append(None)
            stack += reversed(item.children)
    end()
    return out


def main_root(root: Node, order: list[Node]) -> list[Node]:
    """The page's articles, or its main part, or all of it."""
    for tag in ("article", "main"):
        found, inside = [], set()
        for node in order:
            if node.tag == tag and not node.silent and id(node) not in inside:
                found.append(node)
                stack = [node]
                while stack:
                    n = stack.pop()
                    inside.add(id(n))
                    stack += [c for c in n.children if isinstance(c, Node)]
        if found:
            return found
    return [root]


def extract(html: str | None, cut: frozenset[int] = frozenset()) -> str:
    """Main text of one page, without the elements numbered in ``cut``."""
    if not html:
        return ""
    root = parse(html)
    order = name_subtrees(root) if cut else _elements(root)
    dropped = _silent_ids(root)
    text = []
    for part in main_root(root, [n for n in order if id(n) not in dropped]):
        text += blocks(part, cut, order)
    return "\n\n".join(text)


def _elements(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return order[1:]


def _silent_ids(root: Node) -> set[int]:
    """Elements inside silent subtrees, these included."""
    out, stack = set(), [(root, False)]
    while stack:
        node, silent = stack.pop()
        silent = bool(silent or node.silent)
        if silent:
            out.add(id(node))
        stack += [(c, silent) for c in node.children if isinstance(c, Node)]
    return out


def subtrees(pages: DataFrame) -> DataFrame:
    """``page_id, host, node, key, inner, plain, content``: the subtrees whose recurrence can matter.

    Outside articles that is every element with text or children, inside them the
    containers. ``plain``: not silent by itself already. ``content`` stands for the
    page's article, or the whole text where it has none.
    """
    names = ["page_id", "host", "node", "key", "inner", "plain", "content"]

    def run(batches):
        for batch in batches:
            rows = []
            for page, host, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not html or host is None:
                    continue
                root = parse(html)
                order = name_subtrees(root)
                dropped = _silent_ids(root)
                parts = main_root(root, [n for n in order if id(n) not in dropped])
                content = hashlib.md5("\x01".join(p.key for p in parts if p.key).encode()).hexdigest()[:16] if parts != [root] else root.key
                for i, node in enumerate(order):
                    if node.tag in ("html", "body", "head", "article", "main") or not node.children:
                        continue
                    if node.article and node.tag in PROSE:
                        continue
                    if node.article and node.tag not in BLOCKS:
                        continue
                    rows.append((page, host, i, node.key, node.article, id(node) not in dropped, content))
            types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names
            )

    return pages.select("page_id", "host", "html").mapInArrow(
        run, "page_id long, host string, node int, key string, inner boolean, plain boolean, content string"
    )


def templates(found: DataFrame) -> DataFrame:
    """``host, key, inner, contents``: subtrees that recur across many contents of their host."""
    each = found.groupBy("host", "key", "inner", "content").agg(F.count("*").alias("n"))
    counts = each.groupBy("host", "key", "inner").agg(F.count("*").alias("contents"))
    hosts = found.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("all_contents"))
    share = F.col("contents") / F.col("all_contents")
    many = F.when(F.col("inner"), (F.col("contents") >= INNER_CONTENTS) & (share >= INNER_SHARE)).otherwise(
        (F.col("contents") >= LEAST_CONTENTS) & (share >= LEAST_SHARE)
    )
    return counts.where(F.col("contents") >= LEAST_CONTENTS).join(hosts, "host").where(many).select("host", "key", "inner", "contents")


def host_of(url):
    """Host of an address in lower case without port; null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` for every row of ``pages``.

    A null or empty page has an empty text. A page without a host has only its own
    marks to go by. Pages of one id share what is cut from any of them at the same
    element. Other columns are ignored.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    ).withColumn("host", host_of(F.col("url")))
    found = materialize(subtrees(rows), "subtrees")
    template = materialize(templates(found), "templates")
    # Only what a page's own marks leave has to be cut; the table is sized by Spark, which
    # sends it to every task when it is small and moves the pages when it is not.
    cuts = found.where("plain").join(template, ["host", "key", "inner"]).groupBy("page_id", "host").agg(
        F.collect_set("node").alias("cut")
    )
    cuts = materialize(cuts, "cuts")
    named = rows.alias("p").join(cuts.alias("c"), F.expr("p.page_id <=> c.page_id AND p.host = c.host"), "left").select(
        "p.page_id", "p.url", "p.html", "cut"
    )

    def run(batches):
        for batch in batches:
            text = [extract(h, frozenset(c or ())) for h, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return named.mapInArrow(run, "page_id long, url string, text string")
