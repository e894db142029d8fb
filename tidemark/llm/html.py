"""Main text of web pages by line-block distribution.

A page is cut into lines at block-level tags; markup, comments, scripts, styles and forms go. Each line has its text
length, which is zero for lines of menus, headers, footers, sidebars, notices, adverts and reader comments (told by tag,
class, id or role), for lines outside `article` or `main` where a page has one with text, and for lines that are links
for the most part on other pages. The lengths are summed over sliding windows of BLOCK lines. Text surges where a sum
rises from zero above a threshold and dives where sums come back to zero; the lines between a surge and its dive stay,
except those of length zero. Where a page marks its article, the threshold is zero: short paragraphs stay too. Elsewhere
it comes from the page's own lines, and is SURGE at most: a page of short lines keeps them. A line inside such a span is
never dropped or cut for being short.

Names count as whole tokens of class, id or role, each part of which must be known: `cookie-notice` is boilerplate;
`no-sidebar`, `related-work` and `entry-header` are not. Headings have no names, and inside an article an id is one on a
`div` or a list alone, as other ids there are link targets. The name of a wrapper (or a form) never blanks an article
inside it, but articles inside reader comments or related items stay only where no other article has text.

Character references are decoded, white space inside a line becomes one space, lines are trimmed and joined by a
newline. Null, empty and text-free html gives an empty text. Unclosed tags close at the end of the page. Repeated rows
give repeated results; an empty table an empty one. A page is one row of work, in time linear in its length, broken markup
included. Other columns stay; one named like the output gives way to it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK = 3
SURGE = 80

#: Comments, elements without text (to their end tag), other tags, declarations. A tag's attributes are matched here only
#: where no angle bracket stands inside them, so no attempt passes the next one; see _Tags for the others.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"<>]*\"|'[^'<>]*'|[^'\"<>])*)>", re.S | re.I)
_NAME = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
_EVENT = re.compile("['\">]")
_ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SKIP = frozenset("head nav footer aside form button dialog".split())
_MAIN = frozenset("article main".split())
_PLAIN = frozenset("body html article main h1 h2 h3 h4 h5 h6 hgroup".split())
#: Whole tokens of class, id or role: parts that name boilerplate, with parts that say nothing around them.
_PART = r"ads?|adv|advert\w*|banner|breadcrumbs?|consent|cookies?|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|popup|promo|promoted|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|widget|complementary|contentinfo"
_OTHERS = r"comments?|commentlist|disqus|related|replies|reply|respond"
_AROUND = r"area|bar|block|box|buttons?|container|global|icons?|inner|items?|links?|list|main|media|primary|reader|secondary|section|site|slot|thread|top|unit|user|wrap|wrapper"
_BAD_PART, _ANY_PART = re.compile(rf"{_PART}|{_OTHERS}"), re.compile(rf"{_PART}|{_OTHERS}|{_AROUND}")
_READERS = re.compile(rf"(?:.*[_-])?(?:{_OTHERS})(?:[_-].*)?", re.I)
_SPACE = re.compile(r"\s+")


#: Boilerplate: not at all, by a wrapper's name, inside readers' comments or related items, by tag.
TEXT, NAMED, OTHERS, TAGGED = range(4)


def _named(token: str) -> bool:
    """Whether a token's parts are all known, one of them names boilerplate, and no number stands before that one."""
    parts = re.split("[_-]+", token.lower())
    first = next((k for k, p in enumerate(parts) if _BAD_PART.fullmatch(p)), None)
    return first is not None and all(_ANY_PART.fullmatch(p) or k > first and p.isdecimal() for k, p in enumerate(parts))


class _Tags:
    """Ends of tags and declarations that _TOKEN leaves: those with angle brackets between quotes, or that never end.

    Quotes and closing brackets are found once for the page. A search that runs out of them marks the quotes that it passed
    as dead: a later one that comes to such a quote ends there, so all searches together are linear."""

    def __init__(self, html: str):
        self.html, self.dead = html, set()
        self.events = [m.start() for m in _EVENT.finditer(html)]
        # for each event the next one of its own kind
        self.next, seen = [0] * len(self.events), {}
        for k in range(len(self.events) - 1, -1, -1):
            c = html[self.events[k]]
            self.next[k] = seen.get(c, len(self.events))
            seen[c] = k
        self.last_close = html.rfind(">")

    def end(self, at: int) -> int | None:
        """Where the tag whose attributes begin at `at` ends, behind its bracket; None if it doesn't."""
        k, passed = bisect_left(self.events, at), []
        while k < len(self.events) and self.events[k] not in self.dead:
            if self.html[self.events[k]] == ">":
                return self.events[k] + 1
            passed.append(self.events[k])
            k = self.next[k] + 1
        self.dead.update(passed)
        return None

    def close(self, at: int) -> int | None:
        """Behind the next closing bracket."""
        return self.html.find(">", at) + 1 if at <= self.last_close else None


def _tokens(html: str) -> Iterator[tuple[int, int, bool | None, str, str]]:
    """(start, end, whether it closes, tag, attributes) of all markup in order; the third is None for what isn't a tag."""
    at, tags = 0, None
    while (start := html.find("<", at)) >= 0:
        if m := _TOKEN.match(html, start):
            at = m.end()
            yield (start, at, None, "", "") if m[3] is None else (start, at, m[2] == "/", m[3].lower(), m[4])
            continue
        at = start + 1
        tags = tags or _Tags(html)
        if m := _NAME.match(html, start):
            if end := tags.end(m.end()):
                at = end
                yield start, end, m[1] == "/", m[2].lower(), html[m.end() : end - 1]
        elif html[start + 1 : start + 2] in ("!", "?") and (end := tags.close(start + 2)):
            at = end
            yield start, end, None, "", ""


def _boilerplate(tag: str, attributes: str, inside: bool) -> int:
    if tag in _SKIP:
        return NAMED if tag == "form" else TAGGED
    if tag == "header" and not inside:
        return TAGGED
    if tag in _PLAIN and tag != "article" or "=" not in attributes:
        return TEXT
    found = [(m[1].lower(), (m[2] or m[3] or m[4] or "").split()) for m in _ATTR.finditer(attributes)]
    section = any(t == "section" for name, tokens in found if name == "class" for t in tokens)
    level = TEXT
    for name, tokens in found:
        if name == "id" and inside and (tag not in ("div", "ul", "ol") or section):
            continue
        for t in tokens:
            # an article's own header stays, as the tag does
            if _named(t) and not (inside and re.search("header|masthead", t, re.I)):
                others = bool(_READERS.fullmatch(t))
                if tag != "article" or others and "comment" in t.lower():
                    level = max(level, OTHERS if others else NAMED)
    return level


def lines(html: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters inside links, boilerplate, article) of each line; article: 0 outside, 1 inside one, 2 inside one among comments or related items."""
    out: list[tuple[str, int, bool, int]] = []
    parts: list[str] = []
    linked, links = 0, 0
    stack: list[tuple[str, int, int]] = []  # tag, and boilerplate and article around it
    places: dict[str, list[int]] = {}  # where in the stack the open tags of a name are
    blocks = [-1]  # and those that aren't inline
    skip, main = TEXT, 0

    def end() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append((text, linked, skip > TEXT, main))
        parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal skip, main, links
        tag, skip, main = stack.pop()
        places[tag].pop()
        if blocks[-1] == len(stack):
            blocks.pop()
        links -= tag == "a"

    def text_at(a: int, b: int) -> None:
        nonlocal linked
        if b > a:
            t = unescape(html[a:b])
            parts.append(t)
            if links:
                linked += len(t.strip())

    at = 0
    for start, stop, closing, tag, attributes in _tokens(html):
        text_at(at, start)
        at = stop
        if closing is None:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag not in _INLINE
        if block:
            end()
        if closing:
            k = places[tag][-1] if places.get(tag) else -1
            # an inline tag doesn't close the block around it
            if k >= 0 and (block or k > blocks[-1]):
                while len(stack) > k:
                    pop()
        elif tag not in _VOID and not attributes.rstrip().endswith("/"):
            if tag in _CLOSES_P:
                if blocks[-1] >= 0 and stack[blocks[-1]][0] == "p":
                    k = blocks[-1]
                    while len(stack) > k:
                        pop()
            elif tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
                while stack and (stack[-1][0] in _INLINE or stack[-1][0] in (tag, "p")):
                    pop()
            bad = _boilerplate(tag, attributes, main > 0)
            places.setdefault(tag, []).append(len(stack))
            if block:
                blocks.append(len(stack))
            stack.append((tag, skip, main))
            if tag in _MAIN and bad == TEXT and skip < TAGGED:
                main, skip = 2 if skip == OTHERS or main == 2 else 1, TEXT
            else:
                skip = max(skip, bad)
            links += tag == "a"
    text_at(at, len(html))
    end()
    return out


def spans(lengths: list[int], threshold: int, block: int = BLOCK) -> list[tuple[int, int]]:
    """Line spans from a surge of the block sums to the dive behind it."""
    sums = [sum(lengths[i : i + block]) for i in range(len(lengths))]
    out, i = [], 0
    while i < len(sums):
        if sums[i] == 0:
            i += 1
            continue
        j = i
        while j < len(sums) and sums[j] > 0:
            j += 1
        if max(sums[i:j]) > threshold:
            out.append((i, j))
        i = j
    return out


def surge(lengths: list[int], block: int = BLOCK) -> float:
    """The least of SURGE, half of the page's median line and a quarter of its largest block sum."""
    some = [n for n in lengths if n]
    return min(SURGE, median(some) / 2, max(sum(lengths[i : i + block]) for i in range(len(lengths))) / 4) if some else 0


def main_text(html: str | None) -> str:
    found = lines(html or "")
    of = min((article for _, _, bad, article in found if article and not bad), default=0)
    lengths = [0 if bad or article != of and of or not of and 2 * linked > len(text) else len(text) for text, linked, bad, article in found]
    kept = [found[k][0] for a, b in spans(lengths, 0 if of else surge(lengths)) for k in range(a, b) if lengths[k]]
    return "\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with html replaced by the main text."""
    where = pages.columns.index(html_col)
    kept = [f for f in pages.schema if f.name not in (html_col, text_col)]
    keep = [pages.columns.index(f.name) for f in kept]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array([main_text(x) for x in part.column(where).to_pylist()], pa.string())], names=[*(f.name for f in kept), text_col])

    return pages.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"{text_col} string"]))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
