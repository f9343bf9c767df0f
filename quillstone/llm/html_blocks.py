"""Text blocks of a page: one pass over the markup, in time linear in its length.

The cut into tags follows the rules of HTML where they matter for text: comments, bogus comments and raw-text elements
are skipped whole, white space and quotes in tags are read as browsers read them. Tags that are never closed and quotes
that are never ended cost no more than closed ones: where an element of a name is open is kept by name.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose text is not shown where a page is. What stands in for a film or a drawing is read as text.
MUTE = frozenset("template noscript svg".split())
#: Elements whose content is no markup; but for the title it is no text of the page either.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}
#: What an element closes where it begins, as long as the innermost open block is one of these.
_CLOSES = {t: frozenset(("p",)) for t in BLOCK}
_CLOSES |= {"body": frozenset(("head",)), "li": frozenset(("p", "li")), "option": frozenset(("option",)), "optgroup": frozenset(("option", "optgroup"))}
_CLOSES |= {t: frozenset(("p", "dt", "dd")) for t in ("dt", "dd")} | {t: frozenset(("p", "td", "th")) for t in ("td", "th")}
_CLOSES |= {"tr": frozenset(("p", "td", "th", "tr"))} | {t: frozenset(("p", "td", "th", "tr", "thead", "tbody", "tfoot")) for t in ("thead", "tbody", "tfoot")}
#: Elements of which the labeller is told how many are open anywhere above a block.
AROUND = ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "a", "section")
_AROUND_AT = {t: i for i, t in enumerate(AROUND)}
#: Innermost elements of a block's path, and names of one element, that are kept as features. Texts have no such bound.
LEVELS, NAMES = 8, 12
_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>=]+)(?:\s*=\s*(\"|'|[^\s>\"']+))?")
_GAP = re.compile(r"[\s/]*")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")


class Block(NamedTuple):
    path: tuple[tuple[str, ...], ...]
    """Names (tag, then words of class, id and role) of the innermost elements around it, the innermost first."""
    around: bytes
    """For each of AROUND how many are open (3 at most)."""
    text: str
    linked: int
    """Characters inside links."""


class _Page:
    """Open elements and the text of the block that is being read."""

    def __init__(self) -> None:
        self.found: list[Block] = []
        self.open: list[str] = []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of open block elements
        self.path: list[tuple[tuple[str, ...], ...]] = [()]  # path below each open element
        self.text: list[str] = []
        self.linked = self.muted = 0
        self.around = bytearray(len(AROUND))  # ``many``, but 3 at most
        self.many = [0] * len(AROUND)
        self.same: dict = {}  # one object for all equal paths and surroundings

    def count(self, tag: str, n: int) -> None:
        at = _AROUND_AT[tag]
        self.many[at] += n
        self.around[at] = min(self.many[at], 3)

    def flush(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                around = bytes(self.around)
                self.found.append(Block(self.path[-1], self.same.setdefault(around, around), text, min(self.linked, len(text))))
            self.text = []
        self.linked = 0

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        at = len(self.open)
        self.open.append(tag)
        self.where.setdefault(tag, []).append(at)
        above = self.path[-1]
        if tag in BLOCK:
            self.blocks.append(at)
        if tag in BLOCK or tag == "a" or len(names) > 1:
            above = (names, *above[: LEVELS - 1])
            above = self.same.setdefault(above, above)
        self.path.append(above)
        if tag in _AROUND_AT:
            self.count(tag, 1)
        self.muted += tag in MUTE

    def close_from(self, at: int) -> None:
        while len(self.open) > at:
            tag = self.open.pop()
            self.path.pop()
            self.where[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            if tag in _AROUND_AT:
                self.count(tag, -1)
            self.muted -= tag in MUTE

    def start(self, tag: str, names: tuple[str, ...], ends: bool) -> None:
        if tag in BLOCK:
            self.flush()
            closes = _CLOSES[tag]
            while self.blocks and self.open[self.blocks[-1]] in closes:
                self.close_from(self.blocks[-1])
        elif tag == "br":
            self.text.append(" ")
        elif tag == "a" and (at := self.where.get("a")) and (not self.blocks or self.blocks[-1] < at[-1]):
            self.close_from(at[-1])  # links don't nest
        if tag not in VOID and not (ends and tag in ("svg", "math")):
            self.push(tag, names)

    def end(self, tag: str) -> None:
        if tag in BLOCK or tag == "br":
            self.flush() if tag in BLOCK else self.text.append(" ")
        if at := self.where.get(tag):
            # an inline element is not closed from inside a block that is within it: only its marks end
            if tag in BLOCK or not self.blocks or self.blocks[-1] < at[-1] or tag in MUTE or tag == "a":
                self.close_from(at[-1])

    def data(self, data: str) -> None:
        if not self.muted:
            if "&" in data:
                data = unescape(data)
            self.text.append(data)
            if self.around[_AROUND_AT["a"]]:
                self.linked += len(data.strip())


class _Tags:
    """Reads the inside of tags; remembers quotes that end nowhere, so that they are looked for once."""

    def __init__(self, html: str):
        self.html, self.no_more = html, {'"': len(html) + 1, "'": len(html) + 1}

    def close_quote(self, quote: str, at: int) -> int:
        """Place of the quote that ends a value, or -1.

        A name may follow it at once, but not where the value holds the beginning of another tag: such a quote was
        never ended, and the one found opens another value.
        """
        if at >= self.no_more[quote]:
            return -1
        end = self.html.find(quote, at)
        if end < 0:
            self.no_more[quote] = at
            return -1
        behind = self.html[end + 1 : end + 2]
        if behind in (" ", "\n", "\t", "\r", "\f", "/", ">") or behind.isalpha() and self.html.find("<", at, end) < 0:
            return end
        return -1

    def read(self, at: int) -> tuple[int, list[str], bool]:
        """(end of the tag, values of class, id and role with their kind before them, whether it ends itself), from behind the tag's name."""
        html, values = self.html, []
        n = len(html)
        while True:
            m = _ATTR.match(html, at)
            if not m:
                at = _GAP.match(html, at).end()
                if at >= n:
                    return n, values, False
                if html[at] == ">":
                    return at + 1, values, html[at - 1] == "/"
                at += 1  # a stray character
                continue
            key, value = m[1], m[2]
            at = m.end()
            if value in ('"', "'"):
                end = self.close_quote(value, at)
                if end < 0:  # never ended: the tag ends where it seems to
                    end = html.find(">", at)
                    return (n if end < 0 else end + 1), values, False
                value, at = html[at:end], end + 1
            if value and (key := key.lower()) in ("class", "id", "role"):
                values.append(key[0] + value)


def blocks(html: str | None) -> list[Block]:
    """Blocks of a page in page order; none for null or empty html."""
    page = _Page()
    if not html:
        return []
    tags, at, n, find = _Tags(html), 0, len(html), html.find
    names_of: dict[tuple, tuple[str, ...]] = {}
    while at < n:
        lt = find("<", at)
        if lt < 0:
            page.data(html[at:])
            break
        if lt > at:
            page.data(html[at:lt])
        mark = html[lt + 1 : lt + 2]
        if m := _TAG.match(html, lt + 1):
            tag = m[0].lower()
            at, values, ends = tags.read(m.end())
            key = (tag, *values)
            if (names := names_of.get(key)) is None:
                words = [f"{v[0]}:{w.lower()}" for v in values for w in _WORD.findall(v, 1)]
                names = names_of[key] = (tag, *dict.fromkeys(words[:NAMES]))
            if tag in RAW:
                end = _RAW_END[tag].search(html, at)
                stop = end.start() if end else n
                if tag == "title":
                    page.start(tag, names, False)
                    page.data(html[at:stop])
                    page.end(tag)
                at = stop
                if end:
                    gt = find(">", end.end())
                    at = n if gt < 0 else gt + 1
            else:
                page.start(tag, names, ends)
        elif mark == "/":
            if m := _TAG.match(html, lt + 2):
                at, _, _ = tags.read(m.end())
                page.end(m[0].lower())
            else:
                gt = find(">", lt + 2)
                at = n if gt < 0 else gt + 1
        elif html.startswith("<!--", lt):
            if html.startswith(("<!-->", "<!--->"), lt):
                at = find(">", lt) + 1
            else:
                ends_at = [e + len(t) for t in ("-->", "--!>") if (e := tags_find(tags, t, lt + 4)) >= 0]
                at = min(ends_at, default=n)
        elif mark in ("!", "?"):
            gt = find(">", lt + 2)
            at = n if gt < 0 else gt + 1
        else:
            page.data("<")
            at = lt + 1
    page.flush()
    return page.found


def tags_find(tags: _Tags, what: str, at: int) -> int:
    """``find`` that looks only once for what does not come any more."""
    if at >= tags.no_more.get(what, len(tags.html) + 1):
        return -1
    end = tags.html.find(what, at)
    if end < 0:
        tags.no_more[what] = at
    return end
