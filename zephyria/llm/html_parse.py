"""Blocks of text in an HTML page, each with the path of elements above it.

Text of scripts, styles and iframes is left out, to the end of the page where one is not
closed. So is what stands inside ``HIDDEN`` elements (drawings, templates, fallbacks of
media) up to their end; one without an end hides nothing. Formulas belong to the text
around them, without their ``annotation`` in other notations.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

_BOUND = re.compile(r"[\s/>]")
_MARK = re.compile("[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")

#: Elements of HTML with no content, with raw content, and inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe".split())
#: Elements whose content a page does not show as text, and those that end no line whatever they contain.
HIDDEN = frozenset("template svg object canvas video audio annotation annotation-xml".split())
QUIET = frozenset("template svg object canvas video audio math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An open element of this kind ends where one of the given kinds begins.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: A search for the open element that a tag ends stops at these.
SCOPES = frozenset("ul ol dl table select body html article section div main aside nav form".split())


class Path:
    """Elements above a block, linked to the path above; equal paths below one root are one object."""

    __slots__ = ("above", "below", "depth", "element", "known")

    def __init__(self, above: Path | None = None, element: tuple[str, ...] = ()):
        self.above, self.element = above, element
        self.depth: int = above.depth + 1 if above else 0
        self.below: dict[tuple[str, ...], Path] = {}
        self.known: dict = {}  # what others derive from the path

    def child(self, element: tuple[str, ...]) -> Path:
        found = self.below.get(element)
        if found is None:
            found = self.below[element] = Path(self, element)
        return found

    def down(self, elements: Iterable[tuple[str, ...]]) -> Path:
        path = self
        for e in elements:
            path = path.child(e)
        return path

    def derived(self, name: str, first: object, step: Callable) -> object:
        """``step(value of the path above, element)``, computed once a path, from the root down."""
        todo, path = [], self
        while name not in path.known and path.above:
            todo.append(path)
            path = path.above
        value = path.known.setdefault(name, first)
        for path in reversed(todo):
            value = path.known[name] = step(value, path.element)
        return value

    def elements(self) -> tuple[tuple[str, ...], ...]:
        out, path = [], self
        while path.above:
            out.append(path.element)
            path = path.above
        return tuple(reversed(out))


@dataclass
class Block:
    path: Path  # an element is its tag and the words of its class, id and role
    text: str
    link_chars: int


@lru_cache(maxsize=4096)
def element(tag: str, attrs: str) -> tuple[str, ...]:
    words = [w for found in _NAMES.findall(attrs) for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(found)).lower())]
    return (tag, *dict.fromkeys(words))


def raw_end(page: str, tag: str, at: int) -> int:
    begun = re.compile(rf"</{tag}", re.I).search(page, at)
    end = page.find(">", begun.end()) if begun else -1
    return end + 1 if end >= 0 else len(page)


class Tag(NamedTuple):
    start: int
    end: int
    name: str | None  # None for comments and the like
    closes: bool = False
    attrs: str = ""


class Tags:
    """Tags of a page from any place on, in time linear in the page however they are broken off.

    A tag ends at the first ``>`` outside quotes. Where there is none, because a quote stays open
    or the page ends, its ``<`` is text; the ends for all places come from one walk backwards.
    """

    def __init__(self, page: str):
        self.page, self.last_end, self.last_begin = page, page.rfind(">"), page.rfind("<")
        self.marks: list[int] | None = None
        self.ends: list[int] = []
        self.bound = (0, -1)

    def _end(self, at: int) -> int:
        """The place behind the tag whose attributes begin at ``at``, or -1."""
        first = _MARK.search(self.page, at)
        if first is None:
            return -1
        if self.page[first.start()] == ">":
            return first.end()
        if self.marks is None:
            self.marks = [m.start() for m in _MARK.finditer(self.page)]
            self.ends = [-1] * len(self.marks)
            plain = double = single = -1  # the end as seen outside quotes and inside either kind
            for i in range(len(self.marks) - 1, -1, -1):
                mark = self.page[self.marks[i]]
                if mark == ">":
                    plain = self.marks[i] + 1
                elif mark == '"':
                    plain, double = double, plain
                else:
                    plain, single = single, plain
                self.ends[i] = plain
        return self.ends[bisect_left(self.marks, at)]

    def _name_end(self, at: int) -> int:
        if not self.bound[0] <= at <= self.bound[1]:
            found = _BOUND.search(self.page, at)
            self.bound = (at, found.start() if found else len(self.page))
        return self.bound[1]

    def find(self, at: int) -> Tag | None:
        page = self.page
        while (at := page.find("<", at)) >= 0:
            second = page[at + 1 : at + 2]
            if second in ("!", "?"):
                opening, closing = next((o, c) for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")) if page.startswith(o, at))
                end = page.find(closing, at + len(opening))
                return Tag(at, end + len(closing) if end >= 0 else len(page), None)
            closes = second == "/"
            name = at + 1 + closes
            if page[name : name + 1].isalpha() and page[name].isascii():
                if at > self.last_end:
                    if at == self.last_begin:
                        return Tag(at, len(page), None)
                else:
                    name_end = self._name_end(name)
                    end = self._end(name_end)
                    if end >= 0:
                        return Tag(at, end, page[name:name_end].lower(), closes, page[name_end : end - 1])
            at += 1
        return None


def closed(page: str) -> set[int]:
    """Where the start tags of quiet elements end that have an end tag."""
    found: set[int] = set()
    begun: dict[str, list[int]] = {tag: [] for tag in QUIET}
    tags, at = Tags(page), 0
    while tag := tags.find(at):
        at = tag.end
        if tag.closes:
            if begun.get(tag.name):
                found.add(begun[tag.name].pop())
        elif tag.name and not tag.attrs.endswith("/"):
            if tag.name in RAW:
                at = raw_end(page, tag.name, at)
            elif tag.name in QUIET:
                begun[tag.name].append(at)
    return found


class Open:
    """The open elements, with the places of each kind and the path at each place."""

    def __init__(self, root: Path):
        self.names: list[str] = []
        self.paths = [root]  # paths[i] is above element i
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.quiet: int | None = None  # place of the outermost quiet element

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def push(self, name: str, attrs: str) -> None:
        above = self.paths[-1]
        self.places.setdefault(name, []).append(len(self.names))
        if name in SCOPES:
            self.scopes.append(len(self.names))
        self.names.append(name)
        self.paths.append(above if name in INLINE else above.child(element(name, attrs)))

    def close(self, name: str, scoped: bool = False) -> None:
        """End the innermost element of this name, and all inside it; ``scoped``: if no scope is between."""
        at = self.last(name)
        if at < 0 or scoped and self.scopes and self.scopes[-1] > at:
            return
        while len(self.names) > at:
            gone = self.names.pop()
            self.places[gone].pop()
            self.paths.pop()
            if gone in SCOPES:
                self.scopes.pop()
        if self.quiet is not None and at <= self.quiet:
            self.quiet = None

    def path(self) -> Path:
        return self.paths[-1] if self.quiet is None else self.paths[self.quiet]

    def hidden(self) -> bool:
        return self.quiet is not None and any(self.last(name) >= self.quiet for name in HIDDEN)


def blocks(page: str, root: Path | None = None) -> list[Block]:
    """Blocks in page order. Character references are decoded, white space is one space.

    Paths hang below ``root``; pages that share one share equal paths.
    """
    above = Open(root or Path())
    out: list[Block] = []
    held: list[str] = []
    linked = 0
    ended: set[int] | None = None

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(above.path(), text, linked))
            held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if above.hidden():
            return
        text = html.unescape(text) if "&" in text else text
        held.append(text)
        if above.last("a") >= 0:
            linked += len(text)

    tags, at = Tags(page), 0
    while found := tags.find(at):
        if found.start > at:
            add(page[at : found.start])
        at = found.end
        tag = found.name
        if tag is None:
            continue
        if tag in RAW:
            if not found.closes and not found.attrs.endswith("/"):
                at = raw_end(page, tag, at)
            continue
        if tag in QUIET or above.quiet is not None:
            if not found.closes:
                if not found.attrs.endswith("/") and tag not in VOID:
                    if above.quiet is None:
                        ended = closed(page) if ended is None else ended
                        if at not in ended:
                            continue
                        above.quiet = len(above.names)
                    above.push(tag, found.attrs)
                continue
            if above.quiet is None or above.last(tag) >= above.quiet or above.last(tag) < 0:
                above.close(tag)
                continue
        if tag == "br" or tag not in INLINE:
            flush()
        if found.closes:
            above.close(tag)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and "p" in above.names[-8:]:
            above.close("p", scoped=True)
        for kind, enders in ENDED_BY.items():
            if tag in enders:
                above.close(kind, scoped=True)
        above.push(tag, found.attrs)
    if at < len(page):
        add(page[at:])
    flush()
    return out
