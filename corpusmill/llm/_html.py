"""A tolerant HTML reader: tags, text and comments in one pass, and the text blocks of a page with their elements.

Time is linear in the page, however broken it is: what was once looked for in vain
(a quote's end, a tag's end, a closing tag) is not looked for again, and open
elements are found by their name, not by walking down the stack.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is in these is no text. A slash closes an element of FOREIGN at once.
RAW = frozenset("script style textarea title".split())
FOREIGN = frozenset("svg math object iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option select button".split()
)
#: A start tag of the key closes an open element of the value.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P_ENDS = BLOCK - {"body", "html", "head", "option"}
_SCOPE = frozenset("article aside body div dl footer form header html main nav ol section table td ul".split())


@dataclass
class Element:
    tag: str
    names: str  # class, id and role, lower-cased
    hidden: bool  # itself or an element around it
    number: int
    parent: Element | None = None
    inherited: tuple | None = None  # for callers: what they have derived for this element


@dataclass
class Block:
    text: str
    element: Element
    linked: int = 0  # characters within links


def _element(tag: str, attributes: str, number: int, parent: Element) -> Element:
    names, hidden = "", parent.hidden
    if attributes.strip(" /"):
        for m in ATTRIBUTE.finditer(attributes):
            key = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role", "itemprop"):
                names += " " + value.lower()
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.lower().replace(" ", ""):
                hidden = True
    return Element(tag, names, hidden, number, parent)


class _Scanner:
    """Cuts a page into (start, end, closing, tag, attributes) of its tags, comments and sections; tag is empty for the latter two."""

    def __init__(self, page: str):
        self.page, self.failed, self.no_end = page, set(), False

    def _quoted_end(self, at: int) -> int:
        """Where the ``>`` is that ends a tag whose attributes start at ``at``, quotes respected; -1 if there is none."""
        page, tried = self.page, []
        while (m := STOP.search(page, at)) is not None:
            if m[0] == ">":
                return m.start()
            at = m.start()
            if at in self.failed:
                break
            tried.append(at)
            at = page.find(m[0], at + 1) + 1
            if not at:
                break
        self.failed.update(tried)
        return -1

    def tags(self) -> Iterator[tuple[int, int, bool, str, str]]:
        page, at, end = self.page, 0, len(self.page)
        while True:
            start = page.find("<", at)
            if start < 0:
                return
            after = page[start + 1 : start + 2]
            if after in ("!", "?") and after:
                if page.startswith("!--", start + 1):
                    k = page.find("-->", start + 4)
                    stop = end if k < 0 else k + 3
                elif page.startswith("![CDATA[", start + 1):
                    k = page.find("]]>", start + 9)
                    stop = end if k < 0 else k + 3
                else:
                    stop = 0 if self.no_end else page.find(">", start) + 1
                    self.no_end |= not stop
                    if not stop:
                        at = start + 1
                        continue
                at = (yield start, stop, False, "", "") or stop
                continue
            m = NAME.match(page, start + 1)
            if m is None or self.no_end:
                at = start + 1
                continue
            stop = self._quoted_end(m.end())
            if stop < 0:
                stop = page.find(">", m.end())
                if stop < 0:
                    self.no_end = True
                    at = start + 1
                    continue
            at = (yield start, stop + 1, bool(m[1]), m[2].lower(), page[m.end() : stop]) or stop + 1


class _Stack:
    """Open elements, with the places of each tag, of blocks and of scopes."""

    def __init__(self, root: Element):
        self.items, self.places, self.blocks, self.scopes = [root], {}, [], []

    def push(self, element: Element) -> None:
        at = len(self.items)
        self.items.append(element)
        self.places.setdefault(element.tag, []).append(at)
        if element.tag in BLOCK:
            self.blocks.append(at)
        if element.tag in _SCOPE:
            self.scopes.append(at)

    def place(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else 0

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else 0

    def owner(self) -> Element:
        return self.items[self.blocks[-1]] if self.blocks else self.items[0]

    def cut(self, at: int) -> bool:
        """Closes the elements from place ``at`` on; whether a link was open within the first of them."""
        linked = False
        while len(self.items) > at:
            e = self.items.pop()
            self.places[e.tag].pop()
            if e.tag in BLOCK:
                self.blocks.pop()
            if e.tag in _SCOPE:
                self.scopes.pop()
            linked |= e.tag == "a" and len(self.items) > at
        return linked


def blocks(page: str) -> list[Block]:
    """Text blocks in page order: white space collapsed, references decoded; scripts, styles, comments and the head's contents are no text."""
    root = Element("#root", "", False, 0)
    stack, found, pieces, number = _Stack(root), [], [], 0
    linked = in_link = 0
    owner = root
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal pieces, linked
        text = " ".join("".join(pieces).split())
        if text:
            found.append(Block(text, owner, linked))
        pieces, linked = [], 0

    def put(raw: str) -> None:
        nonlocal linked, owner
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if not pieces:
            owner = stack.owner()
        pieces.append(text)
        if in_link:
            linked += len(text.strip())

    at, end = 0, len(page)
    tokens = _Scanner(page).tags()
    jump = None
    while True:
        try:
            start, stop, closing, tag, attributes = tokens.send(jump)
        except StopIteration:
            break
        jump = None
        put(page[at:start])
        at = stop
        if not tag:
            if page.startswith("<![CDATA[", start):
                put(html.escape(page[start + 9 : stop - 3]))
            continue
        if closing:
            if tag in BLOCK:
                flush()
            if tag == "a" and in_link:
                in_link -= 1
            place = stack.place(tag)
            if place and (tag in _SCOPE or place > stack.scope()) and stack.cut(place):
                in_link = 0
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in BLOCK:
            flush()
            shut = CLOSES.get(tag, set()) | ({"p"} if tag in _P_ENDS else set())
            place = max((stack.place(x) for x in shut), default=0)
            if place and place >= stack.scope():
                stack.cut(place)
        if tag in VOID:
            continue
        number += 1
        element = _element(tag, attributes, number, stack.items[-1])
        if tag in RAW:
            close = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            if close is None:
                unclosed.add(tag)
            at = jump = close.end() if close else end
            continue
        if tag in FOREIGN and attributes.rstrip().endswith("/"):
            continue
        if tag == "a":
            in_link += 1
        stack.push(element)
    put(page[at:])
    flush()
    return found


def visible_text(page: str) -> str:
    """All text blocks that are not hidden, joined by one line break."""
    return "\n".join(b.text for b in blocks(page) if not b.element.hidden)
