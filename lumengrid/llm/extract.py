"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read once, tag by tag, into blocks of text between block-level tags. A block's features are its
words and link density, those of the blocks before and behind it, and whether the page's own marks (tags,
roles, class and id names) put it inside or outside the article. The tree is fitted on TRAINING, a small
labelled table, on the driver; it is a few nodes, which go to the workers with the code.

A null or empty page has an empty text. Pages that are cut off lose the tag that is cut. Each row stands
alone; columns other than page_id, url and html are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.llm.common import lean, slices

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_behind", "link_density_behind", "inside", "outside")

#: Blocks with FEATURES, and whether they are main text.
TRAINING = (
    # an article's paragraphs and headings, long and short, with few links
    (60, 0.00, 45, 0.00, 80, 0.00, 1, 0, 1), (8, 0.00, 1, 1.00, 60, 0.00, 1, 0, 1), (3, 0.00, 90, 0.00, 40, 0.02, 1, 0, 1), (1, 0.00, 40, 0.00, 2, 0.00, 1, 0, 1),
    (120, 0.05, 60, 0.00, 12, 0.00, 1, 0, 1), (25, 0.20, 80, 0.00, 70, 0.00, 1, 0, 1), (14, 0.00, 30, 0.10, 4, 1.00, 1, 0, 1), (5, 0.60, 55, 0.00, 48, 0.00, 1, 0, 1),
    (2, 1.00, 35, 0.00, 41, 0.00, 1, 0, 1), (33, 0.00, 5, 0.00, 6, 0.20, 1, 0, 1), (18, 0.00, 2, 1.00, 1, 1.00, 1, 0, 1), (70, 0.00, 8, 0.00, 9, 0.00, 1, 0, 1),
    # very short ones, beside each other and at either end
    (1, 0.00, 1, 0.00, 1, 0.00, 1, 0, 1), (2, 0.00, 3, 0.00, 9, 0.00, 1, 0, 1), (3, 0.00, 2, 1.00, 2, 1.00, 1, 0, 1), (1, 1.00, 1, 1.00, 1, 1.00, 1, 0, 1),
    (2, 1.00, 1, 1.00, 60, 0.00, 1, 0, 1), (4, 0.80, 2, 1.00, 3, 1.00, 1, 0, 1), (12, 0.90, 1, 1.00, 1, 1.00, 1, 0, 1), (5, 0.00, 1, 1.00, 4, 0.00, 1, 0, 1),
    (2, 0.00, 12, 0.00, 40, 0.00, 1, 0, 1), (1, 0.00, 6, 0.00, 0, 0.00, 1, 0, 1), (3, 0.00, 0, 0.00, 3, 0.00, 1, 0, 1), (40, 0.75, 6, 1.00, 5, 1.00, 1, 0, 1),
    # the same without marks around it
    (60, 0.00, 45, 0.00, 80, 0.00, 0, 0, 1), (42, 0.05, 9, 0.00, 33, 0.00, 0, 0, 1), (28, 0.00, 1, 1.00, 55, 0.00, 0, 0, 1), (95, 0.10, 70, 0.00, 3, 1.00, 0, 0, 1),
    (22, 0.00, 40, 0.00, 36, 0.04, 0, 0, 1), (19, 0.00, 33, 0.00, 21, 0.00, 0, 0, 1), (9, 0.00, 50, 0.00, 60, 0.00, 0, 0, 1), (7, 0.00, 61, 0.00, 44, 0.00, 0, 0, 1),
    (6, 0.00, 3, 1.00, 75, 0.00, 0, 0, 1), (10, 0.00, 2, 1.00, 48, 0.00, 0, 0, 1), (35, 0.00, 28, 0.00, 6, 0.00, 0, 0, 1), (16, 0.00, 64, 0.00, 52, 0.00, 0, 0, 1),
    # lone paragraphs, and the last ones of a page without marks
    (27, 0.00, 0, 0.00, 0, 0.00, 0, 0, 1), (18, 0.00, 0, 0.00, 0, 0.00, 0, 0, 1), (34, 0.05, 52, 0.00, 0, 0.00, 0, 0, 1), (21, 0.00, 44, 0.00, 2, 1.00, 0, 0, 1),
    (58, 0.00, 30, 0.00, 3, 1.00, 0, 0, 1), (25, 0.00, 9, 0.00, 0, 0.00, 0, 0, 1), (14, 0.00, 38, 0.00, 0, 0.00, 0, 0, 1), (40, 0.10, 1, 1.00, 0, 0.00, 0, 0, 1),
    # menus, link lists and remarks without marks
    (27, 0.90, 0, 0.00, 0, 0.00, 0, 0, 0), (18, 0.80, 44, 0.00, 0, 0.00, 0, 0, 0), (4, 0.00, 52, 0.00, 0, 0.00, 0, 0, 0), (6, 0.00, 30, 0.00, 3, 1.00, 0, 0, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0), (2, 1.00, 1, 1.00, 60, 0.00, 0, 0, 0), (3, 1.00, 70, 0.00, 2, 1.00, 0, 0, 0), (4, 0.80, 2, 1.00, 3, 1.00, 0, 0, 0),
    (12, 0.90, 1, 1.00, 1, 1.00, 0, 0, 0), (20, 0.70, 30, 0.80, 4, 1.00, 0, 0, 0), (40, 0.75, 6, 1.00, 5, 1.00, 0, 0, 0), (3, 0.00, 2, 1.00, 2, 1.00, 0, 0, 0),
    (5, 0.00, 1, 1.00, 4, 0.00, 0, 0, 0), (2, 0.00, 4, 0.00, 3, 0.00, 0, 0, 0), (4, 0.00, 5, 0.00, 2, 1.00, 0, 0, 0), (6, 0.50, 3, 0.00, 2, 1.00, 0, 0, 0),
    # all that stands in menus, headers, footers, sidebars, notices, adverts, forms and comments
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 1, 0), (9, 0.00, 1, 1.00, 10, 0.00, 0, 1, 0), (24, 0.00, 60, 0.00, 0, 0.00, 0, 1, 0), (55, 0.00, 40, 0.00, 30, 0.00, 0, 1, 0),
    (3, 0.00, 80, 0.00, 12, 0.00, 0, 1, 0), (12, 0.30, 6, 1.00, 70, 0.00, 0, 1, 0), (80, 0.05, 3, 0.00, 90, 0.00, 0, 1, 0), (30, 0.00, 30, 0.00, 28, 0.00, 0, 1, 0),
    (7, 0.00, 50, 0.00, 64, 0.00, 1, 1, 0), (45, 0.00, 38, 0.00, 40, 0.00, 1, 1, 0), (4, 1.00, 60, 0.00, 5, 1.00, 1, 1, 0), (18, 0.00, 9, 0.00, 22, 0.00, 1, 1, 0),
)


class Node(NamedTuple):
    """A test of one feature (below the cut: left), or with feature -1 an answer."""

    feature: int
    cut: float
    left: Node | None
    right: Node | None
    answer: bool


def fit(rows: tuple[tuple[float, ...], ...], depth: int = 6) -> Node:
    """A tree by least Gini impurity, the first feature and lowest cut of equal ones; the last value of a row is its label."""
    good = sum(r[-1] for r in rows)
    leaf = Node(-1, 0.0, None, None, 2 * good > len(rows))
    if not depth or good in (0, len(rows)):
        return leaf
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut, impurity = (a + b) / 2, 0.0
            for part in ([r[-1] for r in rows if r[f] < cut], [r[-1] for r in rows if r[f] >= cut]):
                share = sum(part) / len(part)
                impurity += len(part) * 2 * share * (1 - share)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, cut
    if best is None:
        return leaf
    _, f, cut = best
    return Node(f, cut, fit(tuple(r for r in rows if r[f] < cut), depth - 1), fit(tuple(r for r in rows if r[f] >= cut), depth - 1), False)


def decide(tree: Node, features: tuple[float, ...]) -> bool:
    while tree.feature >= 0:
        tree = tree.left if features[tree.feature] < tree.cut else tree.right
    return tree.answer


VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Their content is never text of the page.
DROPPED = frozenset("script style noscript template iframe object svg math canvas audio video head title select textarea button option datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
OUTSIDE_TAGS = frozenset("nav header footer aside form dialog menu fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
OUTSIDE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar
    footer bottombar copyright sidebar side rail widget widgets notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login
    comment comments commentlist reply replies respond disqus discussion share sharing social related recommended pagination pager toolbar search form""".split()
)
INSIDE_NAMES = frozenset("article post entry story content main body articlebody postbody storybody".split())
#: Beginnings of class names that only tell what a page has or is filed under, and names that do so as a whole.
_ABOUT = ("has-", "no-", "with-", "without-", "is-", "category-", "tag-", "js-", "comments-open", "comments-closed")
#: What may stand in a head whose end tag is left out.
_IN_HEAD = frozenset("title meta link base script style noscript template".split())
# a quote that is never closed ends with its tag
_TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))|[!?/][^>]*(?:>|\Z))", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block(NamedTuple):
    text: str
    words: int
    link_density: float
    inside: bool
    outside: int


#: What puts a block outside: a mark, or a form alone, which may wrap a whole page.
MARK, FORM = 1, 2


def _marks(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether a tag opens the article, and how it opens something outside it."""
    inside, outside = tag in ("article", "main"), FORM if tag == "form" else MARK if tag in OUTSIDE_TAGS else 0
    if attributes and tag not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                inside, outside = inside or value.lower() in ("main", "article"), outside | (value.lower() in OUTSIDE_ROLES)
            elif name in ("class", "id"):
                told = [x for x in value.split() if not x.lower().startswith(_ABOUT)]
                parts = {x.lower() for x in _PARTS.findall(" ".join(told))}
                found = parts & OUTSIDE_NAMES
                outside |= FORM if found == {"form"} else MARK if found else 0
                inside = inside or not parts.isdisjoint(INSIDE_NAMES)
            elif name == "hidden":
                outside |= MARK
    return inside, outside


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]  # tag, inside, outside, dropped
    parts: list[tuple[str, bool]] = []
    link = False

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join([x for x, _ in parts]).split())
            if text:
                words = len(text.split(" "))
                linked = sum(len(x.split()) for x, a in parts if a)
                out.append(Block(text, words, min(1.0, linked / words), stack[-1][1], stack[-1][2]))
            parts = []

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        upto = m.start() if m else n
        if upto > at and not stack[-1][3]:
            parts.append((html.unescape(page[at:upto]), link))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        whole = page[at - 1] == ">"
        if m[1]:  # an end tag
            if tag == "a":
                link = False
            if tag in INLINE:
                continue
            flush()
            if tag in (x[0] for x in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if not whole:
            continue
        if tag == "a":
            link = True
        if tag in INLINE and not (tag == "span" and m[3] and _marks(tag, m[3])[1]):
            continue
        if stack[-1][0] == "head" and tag not in _IN_HEAD:
            stack.pop()  # its end tag was left out
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        flush()
        if tag in RAW:  # all up to its end tag
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        if stack[-1][0] == tag and tag in ("p", "li", "option", "tr", "td", "th", "dt", "dd"):
            stack.pop()  # its end tag was left out
        if tag in INLINE:
            continue
        inside, outside = _marks(tag, m[3])
        _, i, o, d = stack[-1]
        stack.append((tag, i or inside, o | outside, d or tag in DROPPED))
    flush()
    return out


def main_text(page: str, tree: Node) -> str:
    found = blocks(page)
    # a form that holds most of the text which nothing else puts outside is a wrapper
    of = lambda kind: sum(b.words * (1 - b.link_density) for b in found if b.outside == kind)
    clear = (0, FORM) if of(FORM) > of(0) else (0,)
    found = [b._replace(outside=int(b.outside not in clear)) for b in found]
    marked = any(b.inside and not b.outside for b in found)
    none = Block("", 0, 0.0, False, 0)
    kept = []
    for before, b, behind in zip([none, *found], found, [*found[1:], none], strict=False):
        # where the page marks its article, the rest lies outside
        outside = bool(b.outside) or marked and not b.inside
        if decide(tree, (b.words, b.link_density, before.words, before.link_density, behind.words, behind.link_density, b.inside, outside)):
            kept.append(b.text)
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points)."""
    tree = fit(TRAINING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(2).to_pylist()):
                out = [main_text(x, tree) for x in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])
                at += len(part)

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return own.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
