"""Title, language, links and Markdown text out of HTML by one linear scan of its tags.

A page is read once from left to right. Element nesting needs a stack, which no regular expression and no built-in
function has, so a page is a row of an Arrow-batched function; the scan itself is a loop over tags. Every character
is looked at a bounded number of times, whatever is left open or nested how deep.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose text never belongs to an article.
RAW_TEXT_TAGS = frozenset(("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg"))
CHROME_TAGS = frozenset(("head", "nav", "header", "footer", "aside", "form", "button", "select"))
CHROME_CLASSES = frozenset(("ad", "ads", "advert", "advertisement", "cookie-banner", "sidebar", "breadcrumb"))
BLOCK_TAGS = frozenset((
    "p", "div", "article", "section", "main", "body", "html", "ul", "ol", "table",
    "blockquote", "pre", "figure", "figcaption", "dl", "dt", "dd", "hr",
))
HEADINGS = {f"h{n}": n for n in range(1, 7)}
#: Elements that end what is open inside them.
NESTING = CHROME_TAGS | {"div", "article", "section", "main", "body", "html", "table", "ul", "ol", "blockquote", "figure"}
#: Characters within which a tag with quoted ``>`` is looked for; a longer one ends at its first ``>``.
TAG_CHARS = 1 << 16

TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
RAW_END = {name: re.compile(rf"</{name}[ \t\n\r\f]*>", re.I) for name in RAW_TEXT_TAGS}
BLANKS = re.compile(r"[ \t\n\r\f]+")
MARKUP = re.compile(r"<[^>]*>")
REFERENCE = re.compile(r"&(?:#[0-9]{1,7};|#[xX][0-9a-fA-F]{1,6};|[A-Za-z][A-Za-z0-9]*;)")
TEXT_REFERENCE = re.compile(r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]*;?)")


def character(reference: str) -> str:
    """What a character reference stands for; the reference itself where there is no such character."""
    if reference[1] == "#":
        digits = reference[2:].rstrip(";")
        number = int(digits[1:], 16) if digits[0] in "xX" else int(digits)
        if not 0 < number <= 0x10FFFF or 0xD800 <= number <= 0xDFFF:
            return reference
    return unescape(reference).replace("\xa0", " ")


def decoded(text: str, pattern: re.Pattern = TEXT_REFERENCE) -> str:
    """Character references replaced once; a no-break space becomes a blank."""
    return pattern.sub(lambda m: character(m[0]), text) if "&" in text else text


def attributes(text: str) -> dict[str, str]:
    """Attributes by lower-case name, the first of a name; references need their semicolon here."""
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), decoded(double or single or bare, REFERENCE))
    return found


def plain(fragment: str) -> str:
    """Text of a fragment on one line."""
    return BLANKS.sub(" ", decoded(MARKUP.sub("", fragment) if "<" in fragment else fragment)).strip()


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """``(text before, tag name, attributes)`` of every tag in order, end tags with ``/`` before the name.

    Comments and declarations are left out, and the content of raw text elements: for ``title`` it comes in the
    place of the attributes. The last item has an empty name.
    """
    start = at = 0  # of the text that is not handed out yet, and of the search
    unquoted = 0  # before this place tags end at their first '>'
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield page[start:at], "!", ""
            start = at = end + 3 if end >= 0 else len(page)
            continue
        tag = TAG.match(page, at, at + TAG_CHARS) if at >= unquoted else None
        if tag:
            name, text, end = tag[1], tag[2], tag.end()
        elif (follows := page[at + 1:at + 2]) and (follows in "/!?" or follows.isascii() and follows.isalpha()):
            end = page.find(">", at) + 1
            if not end:
                break  # no tag ends any more
            unquoted = max(unquoted, at + TAG_CHARS)
            name, _, text = page[at + 1:end - 1].lstrip("/").partition(" ")
        else:
            at += 1
            continue
        name = name.lower()
        if page[at + 1] == "/":
            yield page[start:at], "/" + name, ""
        elif name in RAW_TEXT_TAGS and not text.rstrip().endswith("/"):
            closing = RAW_END[name].search(page, end)
            content = page[end:closing.start() if closing else len(page)]
            yield page[start:at], name, content if name == "title" and closing else ""
            end = closing.end() if closing else len(page)
        else:
            yield page[start:at], name, text
        start = at = end
    yield page[start:], "", ""


class Article:
    """The parts of a page, filled by one scan."""

    def __init__(self, page: str):
        self.title_tag = self.heading = self.og_title = self.language = ""
        self.pieces: list[str] = []
        self.dropped: list[tuple[int, int]] = []
        self.open: list[list] = []  # name, pieces before, whether furniture, pieces before the first end tag of its kind
        self.counts: Counter[str] = Counter()
        self.code = 0
        self.cells: list[str] = []
        titled = html_seen = False
        in_heading: list[str] | None = None
        for text, name, rest in scan(page):
            if text:
                self.text(text)
                if in_heading is not None:
                    in_heading.append(text)
            if name == "h1" and not self.heading and in_heading is None:
                in_heading = []
            elif name == "/h1" and in_heading is not None:
                self.heading, in_heading = plain("".join(in_heading)) or " ", None
            elif name == "title" and not titled:
                self.title_tag, titled = plain(rest), True
            elif name == "html" and not html_seen:
                self.language, html_seen = attributes(rest).get("lang", ""), True
            elif name == "meta" and not self.og_title and "title" in rest:
                found = attributes(rest)
                if found.get("property", "").strip().lower() == "og:title":
                    self.og_title = BLANKS.sub(" ", found.get("content", "")).strip()
            self.tag(name, rest)
        while self.open:
            self.end_unclosed(self.open.pop())

    def title(self) -> str:
        return self.og_title or self.heading.strip() or self.title_tag

    def text(self, text: str) -> None:
        if self.code:
            self.pieces += [x for line in re.split(r"\r\n?|\n", text) for x in ("\n", BLANKS.sub(" ", decoded(line)))][1:]
        else:
            self.pieces.append(decoded(BLANKS.sub(" ", text)))

    def tag(self, name: str, rest: str) -> None:
        closing = name.startswith("/")
        kind = name[1:] if closing else name
        if kind == "!" or kind in RAW_TEXT_TAGS:
            self.pieces.append(" ")
        elif kind in NESTING:
            if closing:
                self.close(kind)
            else:
                if kind == "body":
                    self.end_head()
                furniture = kind in CHROME_TAGS
                if kind == "div" and "class" in rest.lower():
                    furniture = not CHROME_CLASSES.isdisjoint(attributes(rest).get("class", "").split())
                self.open.append([kind, len(self.pieces), furniture, None])
                self.counts[kind] += 1
        if kind in HEADINGS:
            self.pieces.append("\n\n" if closing else "\n\n" + "#" * HEADINGS[kind] + " ")
        elif kind in BLOCK_TAGS:
            self.code = max(0, self.code + (-1 if closing else 1)) if kind == "pre" else self.code
            self.pieces.append("\n\n")
        elif kind == "br" or name == "tr":
            self.pieces.append("\n")
            if name == "tr":
                self.cells = []
        elif name == "li":
            self.pieces.append("\n- ")
        elif name in ("td", "th"):
            self.cells.append(name)
            self.pieces.append(" | ")
        elif name == "/tr" and self.cells:
            rule = "\n" + " | ---" * len(self.cells) + " |" if "td" not in self.cells else ""
            self.pieces.append(" |" + rule)
            self.cells = []

    def close(self, kind: str) -> None:
        """End the innermost open element of this kind and what is open inside it."""
        if not self.counts[kind]:
            return
        while True:
            element = self.open.pop()
            self.counts[element[0]] -= 1
            if element[0] == kind:
                break
            self.end_unclosed(element)
        if element[2]:
            self.dropped.append((element[1], len(self.pieces)))
        if self.open and self.open[-1][0] == kind == "div" and self.open[-1][3] is None:
            self.open[-1][3] = len(self.pieces)

    def end_unclosed(self, element: list) -> None:
        """Furniture without an end of its own stays, but for a block that holds an end tag of its kind."""
        if element[2] and element[3] is not None:
            self.dropped.append((element[1], element[3]))

    def end_head(self) -> None:
        """A head that is left open ends where the body begins."""
        if self.counts["head"]:
            self.close("head")

    def markdown(self) -> str:
        kept, at = [], 0
        for start, end in sorted(self.dropped):
            if end > at:
                kept += [*self.pieces[at:start], " "]
                at = end
        text = re.sub(" +", " ", "".join([*kept, *self.pieces[at:]]))
        return re.sub(r"\n{3,}", "\n\n", re.sub(" ?\n ?", "\n", text)).strip()


def links(page: str) -> list[str]:
    """Trimmed targets of all ``<a href>`` in page order."""
    return [
        found["href"].strip() for _, name, rest in scan(page)
        if name == "a" and "href" in (found := attributes(rest)) and "=" in rest
    ]


FIELDS = ("title", "title_tag", "language", "content")


@F.pandas_udf(T.StructType([T.StructField(name, T.StringType()) for name in FIELDS]))
def page_fields(html: pd.Series) -> pd.DataFrame:
    """Title, ``title`` element, language and Markdown text of pages, in one scan of each."""
    articles = (Article(page or "") for page in html)
    rows = [(a.title(), a.title_tag, a.language, a.markdown()) for a in articles]
    return pd.DataFrame(rows, columns=list(FIELDS))


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_links(html: pd.Series) -> pd.Series:
    return html.map(lambda page: links(page or ""))


def title_tag(html: Column) -> Column:
    return page_fields(html)["title_tag"]


def extract_title(html: Column) -> Column:
    """``og:title``, else the first ``h1`` with an end, else ``title``; empty when there is none."""
    return page_fields(html)["title"]


def extract_language(html: Column) -> Column:
    return page_fields(html)["language"]


def extract_markdown(html: Column) -> Column:
    """Main text as Markdown: page furniture dropped, headings, lists, tables and the lines of code kept,
    links flattened to their text, images gone."""
    return page_fields(html)["content"]


def hrefs(html: Column) -> Column:
    """Trimmed targets of all ``<a href>`` in page order."""
    return page_links(html)
