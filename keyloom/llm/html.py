"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element. A line's weight is its text length without link text, and nothing in
parts that never hold the article (scripts, styles, forms, menus, headers, footers, sidebars, notices, adverts, comments, by
element, or by the words of class, id and role). The weights in sliding windows of WINDOW lines form a curve; a stretch
begins where it surges to RISE of its peak and ends where it dives below. The lines of all stretches are the core.

The core tells where the article is: in the smallest container that holds all of it, or, if markup names articles (article,
main, or a body of that role) and at least half of the core's weight lies in them, in these. All lines of that place stay but
those of the parts above, however short and wherever an advert or a menu cuts them off; all lines elsewhere go.

Words of class, id and role speak only of parts: an element that holds the page's first heading or a named article
(on pages without either: most of the text) is no advert, whatever its name.

Defined results: null, blank or markup-only pages give an empty text, and pages of link text alone all lines that are in no such
part; unclosed and misnested elements end with their parent; unended comments, scripts and tags end with the page; repeated
rows are extracted each; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import arrow, read, unused

WINDOW, RISE = 3, 0.1
#: On pages without heading and named article, an element with so much of the text is the page's, whatever its name.
MOST = 0.8
#: Elements whose content is text of no page, whatever it holds.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "noembed", "noframes"}
#: Elements that never hold the article.
ASIDE = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "fieldset", "label", "input", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "html", "body", "address", "article", "blockquote", "center", "dd", "details", "dir", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
    "li", "main", "ol", "p", "pre", "section", "summary", "table", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *ASIDE,
}
#: An opening of one of these ends an open one of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "button", "label", "input", "select", "option"}
#: Words of class, id and role that name parts beside the article.
_BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|side-?bar|aside|footer|foot|masthead|topbar|toolbar|cookies?\w*|consent|gdpr|notices?|popup|modal|newsletter|subscri\w+|"
    r"signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|respond|replies|disqus|pagination|pager|widget|contentinfo|complementary|search|skip-link|copyright|disclaimer|alert)(?=$|[\s_-])"
)
#: Words before a part's word that say that it stands beside, not that this is it.
_HAS = re.compile(r"(?:^|\s)(?:has|have|with|without|no|not|show|hide|is|can|js|u)[_-][^\s]*")
_MAIN_ROLES = {"main", "article"}
#: Elements that may be the place of a whole article.
PLACES = {"div", "main", "article", "body", "td", "center"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class _Node:
    name: str
    parent: int
    apart: bool = False  # by element, or hidden
    named: bool = False  # by a word of class, id or role
    article: bool = False
    heading: bool = False  # holds the first heading or a named article
    mass: int = 0


@dataclass
class _Line:
    text: str
    node: int
    links: int


def _parse(page: str) -> tuple[list[_Line], list[_Node]]:
    """The blocks of the page in order, and its elements; node 0 stands for the page."""
    out: list[_Line] = []
    words: list[str] = []
    nodes, stack, linked, depth, seen_h1 = [_Node("", -1)], [0], 0, 0, False

    def flush() -> None:
        nonlocal linked
        if words:
            text = _SPACE.sub(" ", entities.unescape("".join(words))).strip()
            words.clear()
            if text:
                out.append(_Line(text, stack[-1], min(linked, len(text))))
        linked = 0

    def close(upto: int) -> None:
        nonlocal depth
        while len(stack) > upto:
            name = nodes[stack[-1]].name
            if name in BLOCKS:
                flush()
            depth -= name == "a"
            stack.pop()

    def add(raw: str) -> None:
        nonlocal linked
        words.append(raw)
        if depth:
            linked += len(_SPACE.sub(" ", entities.unescape(raw)).strip())

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in VOID:
                if name == "br":
                    words.append(" ")
                continue
            k = next((i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]].name == name), None)
            if k is not None:
                close(k)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if not m[3].rstrip().endswith("/") or name not in ("svg", "math"):
                at = end.end() if end else len(page)
            continue
        if name == "br":
            words.append(" ")
            continue
        if name in BLOCKS or name in CLOSES:
            flush()
        shut = CLOSES.get(name, set()) | ({"p"} if name in _ENDS_P else set())
        if shut:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].name in shut:
                    close(i)
                    break
                if nodes[stack[i]].name in BLOCKS and nodes[stack[i]].name not in shut:
                    break
        if name in VOID:
            continue
        names = {n.lower(): (a or b or c).lower() for n, a, b, c in _NAMES.findall(m[3])} if "=" in m[3] else {}
        named = name not in ("html", "body") and any(_BESIDE.search(_HAS.sub(" ", v)) for v in names.values())
        article = (name in ("article", "main") or names.get("role") in _MAIN_ROLES) and not named
        inside = any(nodes[i].article for i in stack)
        node = _Node(name, stack[-1], name in ASIDE or (name == "header" and not inside) or (name not in ("html", "body") and bool(_HIDDEN.search(m[3]))), named, article)
        if not m[3].endswith("/") or name in BLOCKS:
            nodes.append(node)
            stack.append(len(nodes) - 1)
            depth += name == "a"
            if article or (name == "h1" and not seen_h1):
                seen_h1 |= name == "h1"
                if not any(nodes[i].apart for i in stack):
                    for i in stack[:-1]:
                        nodes[i].heading = True
    add(page[at:])
    flush()
    return out, nodes


def stretches(weights: np.ndarray, window: int = WINDOW, rise: float = RISE) -> list[tuple[int, int]]:
    """[first, last) line of each stretch from a surge of the windowed weights to the next dive."""
    if not weights.any():
        return []
    curve = np.convolve(weights, np.ones(window, np.int64))
    up = np.concatenate(([0], (curve >= max(1.0, rise * curve.max())).astype(np.int8), [0]))
    surge, dive = np.flatnonzero(np.diff(up) == 1), np.flatnonzero(np.diff(up) == -1)
    # a window ends at its place: the first one to reach a line ends there, the last one begins there
    return [(int(a), max(int(a) + 1, int(b) - window + 1)) for a, b in zip(surge, dive)]


def main_text(page: str | None) -> str:
    """The article of one page: its blocks joined by newlines."""
    return "\n".join(line.text for line in main_lines(page)[0])


def main_lines(page: str | None) -> tuple[list[_Line], bool]:
    """The lines of the article, and whether the curve chose their place (else: markup did, with the curve's consent)."""
    lines, nodes = _parse(page or "")
    paths: dict[int, list[int]] = {}

    def path(i: int) -> list[int]:
        if i not in paths:
            paths[i] = [*(path(nodes[i].parent) if i else []), i]
        return paths[i]

    total = 0
    for line in lines:
        if not any(nodes[i].apart for i in path(line.node)):
            total += len(line.text)
            for i in path(line.node):
                nodes[i].mass += len(line.text)
    beside = [n.apart or (n.named and not n.heading and (nodes[0].heading or n.mass <= MOST * total)) for n in nodes]
    able = [not any(beside[i] for i in path(line.node)) for line in lines]
    weights = np.array([len(line.text) - line.links if ok else 0 for line, ok in zip(lines, able)], np.int64)
    core = [i for a, b in stretches(weights) for i in range(a, b) if weights[i]]
    marked = [any(nodes[i].article for i in path(line.node)) for line in lines]
    in_article = sum(int(weights[i]) for i in core if marked[i])
    if core and 2 * in_article >= sum(int(weights[i]) for i in core):
        return [line for line, ok, inside in zip(lines, able, marked) if ok and inside], False
    place = 0
    if core:
        shared = path(lines[core[0]].node)
        for i in core[1:]:
            other = path(lines[i].node)
            shared = [a for a, b in zip(shared, other) if a == b]
        place = next((i for i in reversed(shared) if nodes[i].name in PLACES), 0)
    return [line for line, ok in zip(lines, able) if ok and place in path(line.node)], bool(core)


def extract(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """The columns `keys` of pages and `text`, the main text of each."""
    (body,) = unused(pages, "html")
    rows = pages.select(*keys, F.col(html).alias(body))
    schema = rows.drop(body).withColumn("text", F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*keys, "text"])

    return arrow(rows, run, schema)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
