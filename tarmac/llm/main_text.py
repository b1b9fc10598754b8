"""Operator 6: the main text of web pages by composite text density of their DOM nodes.

A page is parsed into a tree of elements; elements that by their name or role are no article text are left out. A form,
or a class or id with a listed word, only makes an element suspect: it is left out after the densities of the whole page
are known, and not if it holds the greatest density sum or all that the page has in article and main elements. A suspect by an
ambiguous word, or by a part of a longer name, is left out only if it is a small part of the page or has many links.
Each node has its characters C, tags T, and of both those inside links, LC and LT. Its density is C / T, adjusted by
links: log(C * T / (LC * LT)) to a base that grows with the share of links in the node and in the body. A node's density
sum is the sum of its children's densities. The node with the greatest sum holds the article. The least density on its
path to the body is the threshold: other subtrees that reach it, outside this path, count as content too. Where an
article or main element encloses the node, that element is content as a whole, and the threshold holds beside it.
"""

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
# Elements that end an open paragraph: all blocks but those inside tables and lists' own parts.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
# An element of the key's name is ended by a new one of the names given.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
}
SKIPPED = RAW | frozenset(
    "head nav footer aside button select option input svg math canvas audio video object template dialog menu "
    "fieldset datalist map applet".split()
)
SKIPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog menu menubar tablist toolbar".split()
)
# Words in a class or id that mark what is no article text.
SKIPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar "
    "aside nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer masthead header topbar "
    "comment comments reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended widget toolbar toc "
    "copyright legal disclaimer skip hidden".split()
)
# Those that articles' own parts have as well.
AMBIGUOUS = frozenset(
    "aside alert banner copyright consent disclaimer header hidden legal notice notices promotion recommended related "
    "share sharing skip social subscription".split()
)
# Those of readers' comments, which may be longer than the article.
READERS = frozenset("comment comments disqus reply replies respond".split())
# A suspect's least share of the page's text, and the largest share of links in its own text, to count as article text.
LEAST_SHARE = 0.1
MOST_LINKS = 0.3
# The logarithm's base on pages without links, where it would be 1.
LEAST_BASE = 1.5
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Page:
    """The elements of a page in the order of their starts, and its texts with the element each stands in."""

    def __init__(self, source: str):
        self.tags, self.parents, self.skipped = ["body"], [-1], [False]
        self._inside = [False]  # an article or main element, or inside one
        self.suspect = [0]  # 1: by an ambiguous name, 2: by a plain one, 3: by readers' comments
        self.texts: list[tuple[int, str]] = []  # (element, text); a block's start or end is (element, "\n")
        self._stack, at = [0], 0
        while at < len(source):
            found = _TOKEN.search(source, at)
            if found is None:
                self._text(source[at:])
                break
            self._text(source[at : found.start()])
            at = found.end()
            name = (found["name"] or "").lower()
            if not name:
                continue
            if found["end"]:
                self._end(name)
            else:
                self._start(name, found["rest"])
                if name in RAW:
                    end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                    self._stack.pop()

    def _text(self, text: str) -> None:
        if text and not self.skipped[self._stack[-1]]:
            self.texts.append((self._stack[-1], html.unescape(text)))

    def _break(self) -> None:
        self.texts.append((self._stack[-1], "\n"))

    def _start(self, name: str, rest: str) -> None:
        if name in ("html", "body"):
            return
        if name in CLOSES_P:
            self._close("p", CLOSES_P - {"p"} | {"td", "th", "li", "dd", "dt"})
        for open_name, by in CLOSED_BY.items():
            if name in by:
                self._close(open_name, {"ul", "ol", "dl", "table", "select"})
        if name not in INLINE:
            self._break()
        parent = self._stack[-1]
        self.tags.append(name)
        self.parents.append(parent)
        skipped, suspect = self._no_content(name, rest)
        self.skipped.append(self.skipped[parent] or skipped)
        self.suspect.append(suspect)
        self._inside.append(self._inside[parent] or name in CONTENT)
        if name not in VOID:
            self._stack.append(len(self.tags) - 1)

    def _no_content(self, name: str, rest: str) -> tuple[bool, int]:
        """Whether an element is no article text, and how suspect it is."""
        if name in SKIPPED:
            return True, 0
        if name == "header" and not self._inside[self._stack[-1]]:
            return True, 0
        form = 2 if name == "form" else 0
        if name in CONTENT or not rest:
            return False, form
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
        style = given.get("style", "").replace(" ", "").lower()
        if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style:
            return True, 0
        role = given.get("role", "").lower()
        if role in SKIPPED_ROLES:
            return True, 0
        suspect = 2 if role == "form" else form
        for names in f"{given.get('class', '')} {given.get('id', '')}".split():
            parts = _PARTS.findall(_CAMEL.sub(" ", names).lower())
            listed = [x for x in parts if x in SKIPPED_WORDS]
            if listed:
                plain = len(listed) == len(parts) and not AMBIGUOUS.issuperset(listed)
                suspect = max(suspect, (2 if READERS.isdisjoint(listed) else 3) if plain else 1)
        return False, suspect

    def _close(self, name: str, within: set[str] | frozenset[str]) -> None:
        """End the innermost open element of this name, unless one of ``within`` stands between."""
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[i]]
            if tag == name:
                del self._stack[i:]
                self._break()
                return
            if tag in within:
                return

    def _end(self, name: str) -> None:
        if name in ("html", "body", "br"):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[i]]
            if tag == name:
                if name not in INLINE:
                    del self._stack[i + 1 :]
                    self._break()
                del self._stack[i:]
                return
            if name in INLINE and tag not in INLINE:
                return


def _density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    if not chars:
        return 0.0
    tags, other = max(tags, 1), max(chars - link_chars, 1)
    base = math.log(chars / other * link_chars + body_share * chars + math.e)
    ratio = chars / max(link_chars, 1) * tags / max(link_tags, 1)
    return chars / tags * math.log(max(ratio, 1.0)) / math.log(max(base, LEAST_BASE))


def _measured(page: Page, skipped: list[bool]) -> tuple[list[int], list[int], list[float], list[float]]:
    """Characters, characters in links, density and density sum of each element."""
    n = len(page.tags)
    chars, tags, link_chars, link_tags = ([0] * n for _ in range(4))
    for i, text in page.texts:
        if not skipped[i]:
            chars[i] += len(" ".join(text.split()))
    for i in range(n - 1, 0, -1):
        parent = page.parents[i]
        if skipped[i]:
            continue
        if page.tags[i] == "a":
            link_chars[i], link_tags[i] = chars[i], tags[i] + 1
        chars[parent] += chars[i]
        tags[parent] += tags[i] + 1
        link_chars[parent] += link_chars[i]
        link_tags[parent] += link_tags[i]
    share = link_chars[0] / max(chars[0], 1)
    density = [_density(*x, share) for x in zip(chars, tags, link_chars, link_tags, strict=True)]
    sums = [0.0] * n
    for i in range(1, n):
        if not skipped[i]:
            sums[page.parents[i]] += density[i]
    return chars, link_chars, density, sums


def _left_out(page: Page) -> list[bool]:
    """Which elements are no article text, with the suspects that are none and all that is in them."""
    if not any(page.suspect):
        return page.skipped
    n, suspect = len(page.tags), list(page.suspect)
    chars, link_chars, _, sums = _measured(page, page.skipped)
    for i in range(1, n):
        large = chars[i] >= LEAST_SHARE * chars[0] and link_chars[i] <= MOST_LINKS * chars[i]
        if suspect[i] == 1 and large:
            suspect[i] = 0

    def out() -> list[bool]:
        flags = list(page.skipped)
        for i in range(1, n):
            flags[i] = flags[i] or suspect[i] > 0 or flags[page.parents[i]]
        return flags

    left_out = out()
    content = [i for i in range(n) if page.tags[i] in CONTENT and chars[i] and not page.skipped[i]]
    if all(left_out[i] for i in content):
        readers = [False] * n
        for i in range(1, n):
            readers[i] = suspect[i] == 3 or readers[page.parents[i]]
        held = [max(range(n), key=lambda i: (not readers[i], sums[i], -i))]
        held += [i for i in content if not readers[i] and chars[i] >= LEAST_SHARE * chars[0] and not link_chars[i] > MOST_LINKS * chars[i]]
        for i in held:
            while i > 0:
                suspect[i], i = 0, page.parents[i]
        left_out = out()
    return left_out


def main_text(source: str) -> str:
    """The article's text of one page: blocks in page order, joined by one space, white space runs as one space."""
    page = Page(source)
    n, skipped = len(page.tags), _left_out(page)
    chars, _, density, sums = _measured(page, skipped)
    if not chars[0]:
        return ""
    best = max(range(n), key=lambda i: (sums[i], -i))
    if not sums[best]:
        best = 0  # no element holds text: the body does
    path = [best]
    while path[-1]:
        path.append(page.parents[path[-1]])
    chosen = [False] * n
    enclosing = [i for i in path if page.tags[i] in CONTENT]
    content = enclosing[-1] if enclosing else best
    threshold, above = min(density[i] for i in path), set(path[path.index(content) :])
    chosen[content] = True
    for i in range(1, n):
        # Subtrees beside the path, and headings on the way to the article.
        beside = page.parents[i] in above and i not in above and page.parents[i] != content
        if beside and not skipped[i] and (density[i] >= threshold or page.tags[i] in HEADINGS):
            chosen[i] = True
    for i in range(1, n):
        chosen[i] = chosen[i] or chosen[page.parents[i]]
    return " ".join("".join(t for i, t in page.texts if chosen[i] and not skipped[i]).split())


def extract(pages: DataFrame) -> DataFrame:
    """For each row of ``pages`` (page_id, url, html): page_id, url, text and n_chars, the text's code points.

    Null and empty pages, and pages without article text, have an empty text. Pages are parsed whole, rows that repeat
    each; ids and urls may be null. An empty table gives no rows; other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        rows, f"page_id {kind}, url string, text string, n_chars long"
    )
