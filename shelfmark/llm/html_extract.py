"""Main text of web pages from flat text blocks.

A page is cut into text blocks at block elements. Each block is described by its word count and link density, those
of the blocks before and after it, and, as a weak sign, where its elements say that it lies. A decision tree,
trained on the labelled table below, tells main text from the rest.

Names of elements and classes only become the feature ``place``. They give way where they contradict the page: an
article is no furniture because something around it is named so, unless there is another article, and on a page
without such an article an element that holds most of the words is none either.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import small_batches

# Elements of HTML by their part in a page.
NO_TEXT = "script style noscript template textarea title iframe object svg math select button canvas audio video".split()
ASIDE = "nav header footer aside form menu dialog head fieldset".split()
MAIN = "article main".split()
METADATA = "html head base basefont bgsound link meta title script style noscript template".split()
BLOCK = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
CLOSED_BY_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = "navigation banner contentinfo complementary search form dialog alert menu menubar".split()
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner sidebar side nav navbar "
    "navigation menu breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notification alert "
    "popup modal overlay newsletter subscribe subscription signup share sharing social related recommended "
    "recommendations comment comments commentlist disqus replies reply respond widget widgets pagination pager login "
    "search toolbar copyright disclaimer skip".split()
)
#: Parts of a name that leave the part before them its meaning, and first parts that take it away.
PARTS = frozenset(
    "area bar block body bottom box buttons container content form group icons inner item items left link links list menu "
    "message notice outer panel right row section slot text thread top unit wrap wrapper".split()
)
NEGATIONS = frozenset("has have hide is js no non not with without".split())
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # An svg or math that closes itself; a slash in a value without quotes is part of the value.
    r"|<(svg|math)(?=[\s/>])(?:[^'\">/=]++|=\s*+(?:[^\s'\">][^\s>]*+)?|\"[^\"]*+\"|'[^']*+'|/(?!>))*+/>"
    rf"|<({'|'.join(NO_TEXT)})(?=[\s/>])(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\2\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S | re.I,
)

#: Where a block lies: on a page without article, in the article, in a part that is named as something else, or
#: outside of the article of its page.
FREE, INSIDE, ASIDE_PART, OUTSIDE = range(4)
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "place")
LABELLED = """
# Fixed values: words, link density, the same of the blocks before and after, place, main text or not. A row stands
# for all combinations of its alternatives.
# In the article: plain blocks of any length beside anything; links only where both neighbours are text.
1,3,8,20,60,200 0,0.3 0,2,40 0 0,2,40 0,1 1 1
1,3,8,20,60,200 0,0.3 1,8 1 0,2,40 0,1 1 1
2,6,12 0.8,1 20,40 0,0.2 20,40 0,0.2 1 1
1,2,6,12 0.8,1 2,40 0,1 1,8 0.8,1 1 0
1,2,6,12 0.8,1 1,8 0.8,1 2,40 0 1 0
# In parts with another name: nothing but a long text that stands by itself.
1,3,8,20,60,120,200 0,0.3,1 0,3,40,150 0,1 0,4,40,150 0,1 2 0
260,400 0,0.1 0,4 0 0,6 0 2 1
260,400 0,0.1 90,150 0 90,150 0 2 0
# Outside of the article.
1,3,8,20,60,200,400 0,0.3,1 0,3,40,150 0,1 0,4,40,150 0,1 3 0
# On pages without article: long plain blocks.
14,25,60,200 0,0.2 0,2,40 0 0,2,40 0,1 0 1
14,25,60,200 0,0.2 1,4 1 0,2,40 0,1 0 1
# Short plain blocks: headings, short paragraphs beside text or alone.
1,3,6,10 0 0 0 0,8,40 0 0 1
1,3,6,10 0 8,40 0 0,8,40 0 0 1
1,3,6,10 0 1,2 0 8,40 0 0 1
6,8,10 0 1,2 0 0 0 0 1
1,3,6,10 0 1,4 1 20,60 0 0 1
# Short plain blocks of menus, footers and lists of links, and labels among labels.
1,3,6,10 0 1,4 0.8,1 1,4 0.8,1 0 0
1,3,6,10 0 1,4 0.8,1 0 0 0 0
1,3,6,10 0 0 0 1,4 0.8,1 0 0
1,3,6,10 0 2,40 0 1,4 0.8,1 0 0
1,2,3 0 1,2,3 0 1,2,3 0 0 0
# Links: lists of them, and a linked line within the text.
1,2,6,12,30 0.7,1 1,4,20 0.7,1 0,1,4,20 0,0.7,1 0 0
1,2,6,12,30 0.7,1 0,40 0 1,8 0.7,1 0 0
1,3,6 0.7,1 0 0 0 0 0 0
6,12,30 0.8,1 40,60 0 40,60 0 0 1
"""


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    lines = [line.split() for line in LABELLED.splitlines() if line and line[0] != "#"]
    rows = {tuple(map(float, row)) for line in lines for row in product(*[cell.split(",") for cell in line])}
    table = np.array(sorted(row for row in rows if not impossible(row)))
    return table[:, :-1], table[:, -1].astype(int)


def impossible(row: tuple) -> bool:
    """A neighbour without words has no links."""
    return any(row[k] == 0 and row[k + 1] > 0 for k in (2, 4))


@dataclass(frozen=True)
class Node:
    """A leaf with the share of main text, or a question: is the feature at most the limit?"""

    share: float
    feature: int = -1
    limit: float = 0.0
    yes: Node | None = None
    no: Node | None = None


def grown(x: np.ndarray, y: np.ndarray, depth: int = 12, least_rows: int = 1) -> Node:
    """A decision tree by the smallest weighted Gini impurity; of equal splits the first feature and limit."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return Node(share)
    best = None
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for limit in (values[1:] + values[:-1]) / 2:
            yes = x[:, feature] <= limit
            if min(yes.sum(), (~yes).sum()) < least_rows:
                continue
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[yes], y[~yes]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, float(limit))
    if best is None:
        return Node(share)
    _, feature, limit = best
    yes = x[:, feature] <= limit
    return Node(
        share, feature, limit, grown(x[yes], y[yes], depth - 1, least_rows), grown(x[~yes], y[~yes], depth - 1, least_rows)
    )


@cache
def trained_tree() -> Node:
    return grown(*labelled_table())


def is_main(tree: Node, features: tuple) -> bool:
    while tree.feature >= 0:
        tree = tree.yes if features[tree.feature] <= tree.limit else tree.no
    return tree.share >= 0.5


def names_furniture(names: str) -> bool:
    """Whether one of the class names or ids says that an element is not main text."""
    for name in names.lower().split():
        parts = [p.rstrip("0123456789") for p in re.split(r"[_-]+", name)]
        parts = [p for p in parts if p]
        if parts and parts[0] not in NEGATIONS and (
            parts[-1] in HINTS or parts[0] in HINTS and all(p in PARTS or p in HINTS for p in parts[1:])
        ):
            return True
    return False


def set_aside(tag: str, attributes: str) -> bool:
    """Whether an element holds something other than main text, by its name, class, id or role."""
    if tag in ASIDE:
        return True
    if tag in ("html", "body") or not attributes.strip():
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in ROLES or name in ("class", "id") and names_furniture(value):
            return True
    return False


@dataclass
class Mark:
    """An element that says where its text lies: an article, furniture, or both."""

    parent: int
    main: bool
    named: bool
    words: int = 0
    place: int = FREE


def placed(marks: list[Mark], blocks: list[tuple[str, int, float, int]]) -> list[tuple[str, int, float, int]]:
    """The blocks with their place instead of the number of their nearest mark (-1 for none)."""
    for _, words, _, mark in blocks:
        if mark >= 0:
            marks[mark].words += words
    for mark in reversed(marks):
        if mark.parent >= 0:
            marks[mark.parent].words += mark.words

    def covered() -> list[bool]:
        out: list[bool] = []
        for mark in marks:
            out.append(mark.named or mark.parent >= 0 and out[mark.parent])
        return out

    has_main = any(m.main for m in marks)
    if not any(m.main and not c for m, c in zip(marks, covered(), strict=True)):
        # Names that hold most of the page are wrong, and the only articles are articles, whatever is around them.
        half = sum(words for _, words, _, _ in blocks) / 2
        for mark in marks:
            mark.named = mark.named and mark.words <= half
        if has_main and not any(m.main and not c for m, c in zip(marks, covered(), strict=True)):
            for mark in marks:
                mark.named = mark.named and not mark.main
            inside: list[bool] = []
            for mark in marks:
                inside.append(mark.main or mark.parent >= 0 and inside[mark.parent])
            for mark, within in zip(marks, inside, strict=True):
                if not within:
                    mark.named, mark.place = False, ASIDE_PART
    aside = covered()
    for mark, hidden in zip(marks, aside, strict=True):
        above = marks[mark.parent].place if mark.parent >= 0 else OUTSIDE if has_main else FREE
        mark.place = ASIDE_PART if hidden or mark.place == ASIDE_PART else INSIDE if mark.main else above
    free = OUTSIDE if has_main else FREE
    return [(text, words, density, marks[m].place if m >= 0 else free) for text, words, density, m in blocks]


def text_blocks(page: str) -> list[tuple[str, int, float, int]]:
    """Text, words, link density and place of each block in page order."""
    blocks: list[tuple[str, int, float, int]] = []
    text: list[str] = []
    linked: list[str] = []
    marks: list[Mark] = []
    stack: list[tuple[str, int]] = []  # element and its nearest mark
    open_tags: Counter[str] = Counter()
    in_link, mark = False, -1

    def close() -> None:
        if text:
            words = entities.unescape("".join(text)).split()
            if words:
                of_links = len(entities.unescape(" ".join(linked)).split()) if linked else 0
                blocks.append((" ".join(words), len(words), min(1.0, of_links / len(words)), mark))
            text.clear()
            linked.clear()

    def pop() -> str:
        nonlocal mark
        tag, _ = stack.pop()
        open_tags[tag] -= 1
        mark = stack[-1][1] if stack else -1
        return tag

    def leave_head() -> None:
        """A head without end tag ends at the first text or element that cannot be in it."""
        if stack and stack[-1][0] == "head":
            close()
            pop()

    at = 0
    for found in MARKUP.finditer(page):
        if found.start() > at:
            piece = page[at:found.start()]
            if stack and stack[-1][0] == "head" and piece.strip():
                leave_head()
            text.append(piece)
            if in_link:
                linked.append(piece)
        at = found.end()
        closing, tag, attributes = found.group(3, 4, 5)
        if tag is None:
            closing, tag, attributes = found.group(6, 7, 8)
            if tag is None:
                if (found.group(1) or found.group(2) or "title").lower() not in METADATA:
                    leave_head()
                continue
        tag = tag.lower()
        if not closing and tag not in METADATA:
            leave_head()
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS:
            close()
            in_link = False
            if closing:
                if open_tags[tag]:
                    while pop() != tag:
                        pass
            else:
                if stack and stack[-1][0] in CLOSED_BY_BLOCK:
                    pop()
                if tag not in VOIDS:
                    main, named = tag in MAIN, set_aside(tag, attributes)
                    if main or named:
                        marks.append(Mark(mark, main, named))
                        mark = len(marks) - 1
                    stack.append((tag, mark))
                    open_tags[tag] += 1
    if at < len(page):
        if page[at:].strip():
            leave_head()
        text.append(page[at:])
    close()
    return placed(marks, blocks)


BLOCKS, VOIDS = frozenset(BLOCK), frozenset(VOID)


def main_text(page: str, tree: Node | None = None) -> str:
    """The blocks that are main text, in page order, joined by an empty line."""
    tree = tree or trained_tree()
    blocks = text_blocks(page)
    none = ("", 0, 0.0, FREE)
    kept = []
    for i, (text, words, density, place) in enumerate(blocks):
        before = blocks[i - 1] if i else none
        after = blocks[i + 1] if i + 1 < len(blocks) else none
        if is_main(tree, (words, density, before[1], before[2], after[1], after[2], place)):
            kept.append(text)
    return "\n\n".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row: the main text of the whole html.

    Text is empty if the html is NULL, empty or has no main text; markup that is cut off or not closed runs to
    its natural end. Repeated rows get a row each; an empty table gives none; NULL ids and addresses stay;
    other columns are not read.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = trained_tree()
        for batch in batches:
            yield pd.Series([main_text(page, tree) for page in batch], dtype=object)

    small_batches(pages.sparkSession)
    extract = F.pandas_udf(run, "string")
    rows = pages.select("page_id", "url", extract(F.coalesce("html", F.lit(""))).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("bigint"))
