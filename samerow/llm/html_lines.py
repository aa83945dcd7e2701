"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped so that every block of the page is a line with a weight, its length. What the markup says is
evidence on lines: link text weighs next to nothing; elements that are never article text (menus, notices, forms,
scripts, reader comments and the like) become an empty line, and the borders of page sections as many as a window
is long; and if article and main elements hold most of the text that is left, lines inside them weigh more by
what a surge takes, and lines outside nothing.

The weight of each window of lines then rises from zero where text begins (a surge) and falls back to zero where it
ends (a dive). What lies between is kept whole if its densest window is dense enough; if no stretch is, the heaviest
one is kept, so a short article is not lost.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from samerow.llm.tasks import map_batches, slices, text_column

WINDOW = 3
# Weight that the densest window of a stretch has at least.
SURGE = 80

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ARTICLE_TAG = re.compile(r"<(?:article|main)[\s>]", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")

# HTML element names and words by their role on a page.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "canvas", "object", "select", "title", "annotation", "annotation-xml"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr",
    "math", "menclose", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow",
    "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ARTICLE = {"article", "main"}
# Elements whose removal ends a stretch; others leave one empty line, however many follow each other.
BORDERS = {"header", "footer", "head"}
SECTIONS = {"html", "body", "article", "main", "nav", "footer", "aside", "header", "head"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu"}
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "popup", "promo", "related", "reply", "replies", "share", "sharing", "sidebar", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
# Of these, reader comments: never article text, however long they are.
COMMENTS = {"comment", "comments", "disqus", "replies", "reply"}
# Before or after a word these tell a state of something else: no-sidebar, has-comments, share-enabled.
BEFORE = {"no", "not", "non", "has", "have", "with", "without"}
AFTER = {"enabled", "disabled", "open", "closed", "on", "off", "allowed"}
# Words that also stand in anchors made from headings (related-work); in an id they count beside layout words only.
PROSE = {
    "banner", "comment", "comments", "consent", "cookie", "cookies", "menu", "navigation", "notice", "promo", "related",
    "reply", "replies", "share", "sharing", "social", "sponsor", "subscribe",
}
LAYOUT = {
    "area", "bar", "block", "bottom", "box", "buttons", "container", "form", "icons", "inner", "left", "links", "list", "main",
    "outer", "page", "popup", "posts", "primary", "right", "secondary", "section", "site", "thread", "top", "wrap", "wrapper",
}
# Elements that an id can name as a part of the page; of others it is an anchor. Inside an article, also a section's is.
NAMED = {"center", "dl", "div", "fieldset", "ol", "section", "table", "tbody", "td", "tr", "ul"}


class Weights:
    """Where a page's elements end, and its text is: the text inside article or main elements, if a good part is.

    Raw elements, menus, footers and the like don't count as text, unless they hold the article.
    """

    def __init__(self, page: str):
        self.page = page
        self.closed: dict[str, dict[int, int]] = {}
        ends: tuple[list[int], list[int]] = ([], [])  # of texts anywhere, inside articles
        sums: tuple[list[int], list[int]] = ([0], [0])
        inside = at = 0

        def take(start: int, end: int) -> None:
            if size := len("".join(page[start:end].split())):
                for k in (0, 1) if inside else (0,):
                    ends[k].append(end)
                    sums[k].append(sums[k][-1] + size)

        while (m := _TAG.search(page, at)) is not None:
            take(at, m.start())
            at = m.end()
            name = (m[2] or "").lower()
            if not m[1] and name in RAW:
                at = _raw_end(page, name, at)
            elif not m[1] and name in BOILERPLATE and name != "form":
                end = self.end_of(name, m.start(), at)
                if end is not None and (inside or not _ARTICLE_TAG.search(page, at, end)):
                    at = end
            elif name in ARTICLE:
                inside = max(0, inside + (-1 if m[1] else 1))
        take(at, len(page))
        apart = sums[1][-1] > 0 and 10 * sums[1][-1] >= sums[0][-1]
        self.ends, self.sums = ends[apart], sums[apart]

    def end_of(self, name: str, start: int, at: int) -> int | None:
        """Where the element with the tag from ``start`` to ``at`` ends, or None if it is never closed.

        All elements of a name are matched in one pass, since many can be nested.
        """
        if name not in self.closed:
            closed, opened = {}, []
            for m in _tags(name).finditer(self.page):
                if m[0].startswith("<!--"):
                    continue
                if not m[1]:
                    opened.append(m.start())
                    closed[m.start()] = -1
                elif opened:
                    closed[opened.pop()] = m.end()
            self.closed[name] = closed
        if (end := self.closed[name].get(start)) is None:  # the pass took the tag for part of a comment
            return _end_of(self.page, name, at)
        return end if end >= 0 else None

    def most(self, start: int, end: int) -> bool:
        """Whether more than half of the text is between two tags."""
        size = self.sums[bisect_left(self.ends, end + 1)] - self.sums[bisect_left(self.ends, start + 1)]
        return 2 * size > self.sums[-1]


@dataclass(frozen=True)
class Line:
    """A block of text, whether it is inside an article element, and how much of it is no link. Empty: a gap."""

    text: str = ""
    inside: bool = False
    plain: int = 0


def lines_of(page: str, weights: Weights) -> list[Line]:
    """The page as lines of text, one per block; empty ones stand where something was taken out."""
    lines: list[Line] = []
    block: list[str] = []
    linked = links = 0  # characters of the block in links, and open links
    inside = 0  # open article elements
    at = 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(block).split())
        block.clear()
        if text:
            lines.append(Line(text, inside > 0, max(1, len(text) - linked)))
        linked = 0

    def gap(n: int) -> None:
        while n > 0 and not (len(lines) >= n and not any(x.text for x in lines[-n:])):
            lines.append(Line())

    def take(text: str) -> None:
        # A tag inside a block is no white space, and a reference never reaches over one.
        nonlocal linked
        if text:
            block.append(html.unescape(text))
            linked += len(block[-1].strip()) if links else 0

    while (m := _TAG.search(page, at)) is not None:
        take(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        opening = not m[1]
        if opening and name in RAW:
            at = _raw_end(page, name, at)
            continue
        if opening and name not in VOID and (kind := _boilerplate(name, m[3], inside)):
            end = weights.end_of(name, m.start(), at)
            if end is not None and not (_holds_article(page, at, end, inside) if kind == "comments" else weights.most(at, end)):
                close()
                gap(WINDOW if name in BORDERS and not inside else 1)
                at = end
                continue
        if name == "a":
            links = 1 if opening else 0
        if name in INLINE:
            continue
        close()
        if name in ARTICLE:
            # Articles within the text of others belong to it.
            if not inside or (inside == 1 and not opening):
                gap(WINDOW)
            inside = max(0, inside + (1 if opening else -1))
        elif name in SECTIONS - {"nav", "aside"} and not inside:
            gap(WINDOW)
    take(page[at:])
    close()
    return lines


def _holds_article(page: str, start: int, end: int, inside: int) -> bool:
    """Does an element that is in no article hold one with some text? Then it is no thread of comments."""
    if inside:
        return False
    found = _ARTICLE_TAG.search(page, start, end)
    return found is not None and found[0].lower().startswith("<main")


def weighed(lines: list[Line], surge: int = SURGE) -> list[int]:
    """Weights of the lines: by the article elements if these hold at least half of the text."""
    within = sum(len(x.text) for x in lines if x.inside)
    if within and 2 * within >= sum(len(x.text) for x in lines):
        return [x.plain + surge if x.inside and x.text else 0 for x in lines]
    return [x.plain for x in lines]


def _boilerplate(name: str, attributes: str, inside: int) -> str:
    """``comments`` for an element of reader comments, ``other`` for one of other boilerplate, else empty."""
    if attributes.strip() and name not in ("html", "body", "main", "head") and (name != "article" or inside):
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            if key.lower() in ("class", "id") and any(_names_comments(x) for x in html.unescape(a or b or c).lower().split()):
                if key.lower() == "class" or (name in NAMED and not (name == "section" and inside)):
                    return "comments"
    return "other" if _is_boilerplate(name, attributes, inside) else ""


def _names_comments(token: str) -> bool:
    """Whether a class or id is of a thread of comments: made of such words, layout words and numbers only."""
    parts = [x for x in _PARTS.split(token) if x]
    return not COMMENTS.isdisjoint(parts) and all(x in COMMENTS or x in LAYOUT or x.isdigit() for x in parts)


def _is_boilerplate(name: str, attributes: str, inside: int) -> bool:
    if name in BOILERPLATE or (name == "header" and not inside):
        return True
    if name in SECTIONS or not attributes.strip():
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape(a or b or c).lower()
        if key == "class" and any(_names_boilerplate(x) for x in value.split()):
            return True
        if key == "id" and name in NAMED and not (name == "section" and inside):
            if any(_names_boilerplate(x, PROSE) for x in value.split()):
                return True
        if key in ("class", "id") and name == "div" and not inside and not {"header", "site-header"}.isdisjoint(value.split()):
            return True
        if key == "role" and value.strip() in ROLES:
            return True
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _names_boilerplate(token: str, prose: frozenset[str] | set[str] = frozenset()) -> bool:
    """Whether a class or id has one of the words, not as a state, and one of ``prose`` not among other words."""
    parts = [x for x in _PARTS.split(token) if x]
    plain = all(x in WORDS or x in LAYOUT or x.isdigit() for x in parts)
    return any(
        x in WORDS and (plain or x not in prose) and BEFORE.isdisjoint(parts[:i]) and AFTER.isdisjoint(parts[i + 1 :])
        for i, x in enumerate(parts)
    )


def _raw_end(page: str, name: str, at: int) -> int:
    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
    return end.end() if end else len(page)


def _tags(name: str) -> re.Pattern:
    return re.compile(rf"<!--.*?-->|<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I | re.S)


def _end_of(page: str, name: str, at: int) -> int | None:
    """Where the element opened before ``at`` ends, or None if it is never closed."""
    depth = 1
    for m in _tags(name).finditer(page, at):
        if m[0].startswith("<!--"):
            continue
        depth += -1 if m[1] else 1
        if depth == 0:
            return m.end()
    return None


def windows(weights: list[int], window: int = WINDOW) -> list[int]:
    """For each line the weight of the window that begins there."""
    upto = [0, *accumulate(weights)]
    return [upto[min(i + window, len(weights))] - upto[i] for i in range(len(weights))]


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """First and end of the lines from each surge to the next dive: where windows have weight without a break."""
    dense = windows(weights, window)
    found = []
    for filled, group in groupby(range(len(weights)), key=lambda i: dense[i] > 0):
        if filled:
            places = list(group)
            found.append((places[0], places[-1] + 1))
    return found


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article of a page: its blocks in page order, joined by a space."""
    lines = lines_of(page, Weights(page))
    weights = weighed(lines, surge)
    found = [(max(windows(weights[a:b], window)), sum(weights[a:b]), a, b) for a, b in stretches(weights, window)]
    kept = [x for x in found if x[0] >= surge]
    if not kept and found:
        kept = [max(found, key=lambda x: x[1])]
    return " ".join(lines[i].text for _, _, a, b in kept for i in range(a, b) if weights[i])


EXTRACTED = "page_id bigint, url string, text string, n_chars bigint"


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", surge: int = SURGE
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``, from its whole html.

    ``text`` is empty for a null or empty page and for one without text; ``n_chars`` are its code points. Broken
    markup is read as it comes: unclosed elements end with the page, and a ``<`` that opens no tag is text. Rows
    that repeat are pages like others. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for each in batches:
            for b in slices(each, "html"):
                texts = [main_text(x, surge=surge) for x in text_column(b, "html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.selectExpr(f"cast(`{id_col}` as bigint) as page_id", f"cast(`{url_col}` as string) as url", f"`{html_col}` as html")
    return map_batches(rows, run, EXTRACTED)
