"""Selectors of page elements, compiled to small automata that run while a page is parsed, once for all of them.

A selector is a chain of steps, ``tag``, ``*``, ``.class``, ``#id``, ``[attribute]``, ``[attribute=value]`` (also ``~=``, ``^=``,
``$=``, ``*=``), ``:first-child`` and, in the last step, ``:last-child``, joined by a blank (anywhere inside) or ``>`` (directly
inside). For an element the automaton holds which numbers of steps are matched at it, and at it or around it: two bit sets that
follow from those of its parent. :class:`Find` looks for elements and, within each of them, for parts by selectors of their own.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style"))
#: Elements that end when one of these begins inside the same parent.
CLOSED_BY = {"td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "tr": ("tr",), "li": ("li",), "p": ("p", "div", "table", "ul", "ol", "h1", "h2", "h3", "article")}
INLINE = frozenset("a abbr b code em font i small span strong sub sup u".split())

_TEST = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<class>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<how>[~^$*]?=)(?P<value>\"[^\"]*\"|'[^']*'|[^\]]*))?\]|:(?P<place>first-child|last-child)")
_HOW = {
    "=": lambda own, value: own == value,
    "~=": lambda own, value: value in own.split(),
    "^=": lambda own, value: bool(value) and own.startswith(value),
    "$=": lambda own, value: bool(value) and own.endswith(value),
    "*=": lambda own, value: bool(value) and value in own,
}


@dataclass(frozen=True)
class Step:
    child: bool
    tag: str | None = None
    tests: tuple[tuple[str, str, str], ...] = ()
    first: bool = False
    last: bool = False

    def fits(self, tag: str, attributes: Mapping[str, str], first: bool) -> bool:
        if self.tag and self.tag != tag or self.first and not first:
            return False
        return all(name in attributes and (not how or _HOW[how](attributes[name], value)) for name, how, value in self.tests)


@cache
def steps(selector: str) -> tuple[Step, ...]:
    """The steps of a selector; one that can't be read, or asks for ``:last-child`` before its last step, is a ``ValueError``."""
    found, at, child = [], 0, False
    text = selector.strip()
    while at < len(text):
        if text[at] == ">":
            if child:
                raise ValueError(f"two > in {selector!r}")
            child, at = True, at + 1
        while at < len(text) and text[at].isspace():
            at += 1
        if at < len(text) and text[at] == ">":
            continue
        tag, tests, first, last, begin = None, [], False, False, at
        while m := _TEST.match(text, at):
            if m["tag"] and at > begin:
                break
            if m["tag"]:
                tag = None if m["tag"] == "*" else m["tag"].lower()
            elif m["class"]:
                tests.append(("class", "~=", m["class"]))
            elif m["id"]:
                tests.append(("id", "=", m["id"]))
            elif m["name"]:
                value = m["value"] or ""
                tests.append((m["name"].lower(), m["how"] or "", value[1:-1] if value[:1] in ("'", '"') else value))
            else:
                first, last = first or m["place"] == "first-child", last or m["place"] == "last-child"
            at = m.end()
        if at == begin:
            raise ValueError(f"cannot read {selector!r} from {text[at:]!r} on")
        found.append(Step(child, tag, tuple(tests), first, last))
        child = False
        while at < len(text) and text[at].isspace():
            at += 1
    if child or not found or any(s.last for s in found[:-1]):
        raise ValueError(f"{selector!r} is no selector that a single parse can decide")
    return tuple(found)


#: Before the first step: nothing matched yet, around an element and at it.
START = (1, 1)


def advance(chain: tuple[Step, ...], state: tuple[int, int], tag: str, attributes: Mapping[str, str], first: bool) -> tuple[int, int]:
    """The state of an element inside one of ``state``: numbers of steps matched (at it or around it, at it), as bits."""
    around, at = state
    here = 0
    for k, step in enumerate(chain):
        if (at if step.child else around) >> k & 1 and step.fits(tag, attributes, first):
            here |= 2 << k
    return around | here, here


@dataclass(frozen=True)
class Find:
    """Elements that ``selector`` matches, with the texts of the ``parts`` within each."""

    selector: str
    parts: Mapping[str, str] = field(default_factory=dict)


@dataclass
class _Match:
    """A matched element, or a part of one (then it has no parts)."""

    attributes: dict[str, str]
    within: list[str]
    parts: dict[str, list[_Match]]
    pieces: list[str] = field(default_factory=list)
    kept: bool = True

    def text(self) -> str:
        return re.sub(r"\s+", " ", "".join(self.pieces)).strip()


@dataclass
class _Open:
    """An element that hasn't ended."""

    tag: str
    label: str
    states: list[tuple[int, int]]
    #: Matches around or at this element whose parts are looked for in it, with the states of those.
    scopes: list[tuple[_Match, int, list[tuple[int, int]]]]
    #: What this element's own text goes to.
    own: list[_Match]
    children: int = 0
    #: Matches of the last child so far that asked for the last one.
    waiting: list[_Match] = field(default_factory=list)


class Page(HTMLParser):
    """One page, parsed for some finds; ``found`` has a list of matches for each, in the order in which they begin."""

    def __init__(self, finds: list[Find]) -> None:
        super().__init__(convert_charrefs=True)
        self.finds = finds
        self.chains = [steps(f.selector) for f in finds]
        self.inner = [[(name, steps(s)) for name, s in f.parts.items()] for f in finds]
        self.found: list[list[_Match]] = [[] for _ in finds]
        self.open = [_Open("", "", [START] * len(finds), [], [])]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # A new cell or row ends the one before it, but not one outside the innermost table.
        while len(self.open) > 1:
            inner = self.open[-1].tag
            if tag in CLOSED_BY.get(inner, ()) or tag in ("td", "th", "tr") and inner in INLINE and any(e.tag in ("td", "th") for e in self.open):
                self._end()
            else:
                break
        if tag not in INLINE:
            self._text(" ")
        attributes = {name: value or "" for name, value in reversed(attrs)}
        parent = self.open[-1]
        first = parent.children == 0
        parent.children += 1
        for match in parent.waiting:
            match.kept = False
        parent.waiting = []
        label = f"{tag} {' '.join(attributes.get('class', '').split())} "
        states = [advance(chain, state, tag, attributes, first) for chain, state in zip(self.chains, parent.states, strict=True)]
        scopes, own = [], []
        for match, which, inside in parent.scopes:
            moved = []
            for (name, chain), state in zip(self.inner[which], inside, strict=True):
                moved.append(advance(chain, state, tag, attributes, first))
                if moved[-1][1] >> len(chain) & 1:
                    part = _Match(attributes, [], {})
                    match.parts[name].append(part)
                    own.append(part)
                    if chain[-1].last:
                        parent.waiting.append(part)
            scopes.append((match, which, moved))
        for which, (chain, state) in enumerate(zip(self.chains, states, strict=True)):
            if state[1] >> len(chain) & 1:
                match = _Match(attributes, [e.label for e in self.open[1:]], {name: [] for name, _ in self.inner[which]})
                self.found[which].append(match)
                own.append(match)
                scopes.append((match, which, [START] * len(self.inner[which])))
                if chain[-1].last:
                    parent.waiting.append(match)
        if tag not in VOID:
            self.open.append(_Open(tag, label, states, scopes, own))

    def handle_endtag(self, tag: str) -> None:
        if any(e.tag == tag for e in self.open[1:]):
            while self._end() != tag:
                pass
        if tag not in INLINE:
            self._text(" ")

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag not in HIDDEN:
            self._text(data)

    def _text(self, data: str) -> None:
        for e in self.open:
            for match in e.own:
                match.pieces.append(data)

    def _end(self) -> str:
        return self.open.pop().tag

    def close(self) -> None:
        super().close()
        del self.open[1:]


def parse(html: str | None, finds: list[Find]) -> list[list[_Match]]:
    """The matches of each find, without those that turned out not to be the last child."""
    page = Page(finds)
    page.feed(html or "")
    page.close()
    for matches in page.found:
        for m in matches:
            m.parts = {name: [p for p in parts if p.kept] for name, parts in m.parts.items()}
    return [[m for m in matches if m.kept] for matches in page.found]
