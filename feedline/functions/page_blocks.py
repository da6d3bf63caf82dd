"""The blocks of one HTML page, found in one pass over its tags.

A stack for each tag name says where an element ends: at the closing tag of its own
name and depth.  Work is linear in the tags of a page, times the nesting depth of
blocks, and needs nothing but the page itself.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

from feedline.functions.markup import ATTRIBUTE, HIDDEN, TOKEN, VOID_TAGS
from feedline.functions.text import WHITE_SPACE

_HIDDEN, _TOKEN, _ATTRIBUTE = (re.compile(p, re.ASCII) for p in (HIDDEN, TOKEN, ATTRIBUTE))
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)", re.ASCII)
_QUOTED = re.compile(r"""^(["'])(.*)\1$""", re.ASCII | re.DOTALL)
_END = 1 << 62


def _classes(token: str) -> frozenset[str]:
    for name, value in _ATTRIBUTE.findall(token):
        if name.lower() == "class":
            return frozenset(re.split(r"\s+", unescape(_QUOTED.sub(r"\2", value)), flags=re.ASCII)) - {""}
    return frozenset()


def _matches(selector: dict, tag: str, classes: frozenset[str]) -> bool:
    """An opening tag meets the selector."""
    if "tag" in selector and tag != selector["tag"]:
        return False
    if "class" in selector and selector["class"] not in classes:
        return False
    if "class_any" in selector and classes.isdisjoint(selector["class_any"]):
        return False
    return "class_prefix" not in selector or any(c.startswith(selector["class_prefix"]) for c in classes)


class _Element:
    """An opening tag: where it stands and where its element ends."""

    __slots__ = ("tag", "classes", "pos", "end", "block")

    def __init__(self, tag: str, classes: frozenset[str], pos: int, block: bool) -> None:
        self.tag, self.classes, self.pos, self.end, self.block = tag, classes, pos, _END, block


class _Block:
    """A block's own position, the opening tags in it and its texts, in document order."""

    __slots__ = ("pos", "elements", "texts")

    def __init__(self, pos: int) -> None:
        self.pos, self.elements, self.texts = pos, [], []

    def text(self, low: int, high: int) -> str:
        return " ".join(t for at, t in self.texts if low < at < high)


def _read(html: str, selector: dict) -> list[_Block]:
    """All blocks of the page in document order."""
    open_by_tag: dict[str, list[_Element]] = {}
    found: list[_Block] = []
    around: list[_Block] = []
    for pos, match in enumerate(_TOKEN.finditer(_HIDDEN.sub("", html))):
        token = match.group()
        named = _NAME.match(token)
        if not named:
            text = unescape(token).strip(WHITE_SPACE)
            if text:
                for block in around:
                    block.texts.append((pos, text))
            continue
        tag = named.group(1).lower()
        if token.startswith("</"):
            opened = open_by_tag.get(tag)
            if opened:
                element = opened.pop()
                element.end = pos
                if element.block:
                    around.pop()
            continue
        classes = _classes(token) if "class" in token.lower() else frozenset()
        element = _Element(tag, classes, pos, _matches(selector, tag, classes))
        for block in around:
            block.elements.append(element)
        if tag in VOID_TAGS or token.endswith("/>"):
            element.end = pos
            if element.block:
                found.append(_Block(pos))
            continue
        open_by_tag.setdefault(tag, []).append(element)
        if element.block:
            around.append(_Block(pos))
            found.append(around[-1])
    return found


def _field(block: _Block, field: dict) -> str | list[str] | None:
    if field.get("self"):
        return block.text(-1, _END)
    low, high = block.pos, _END
    if "within" in field:
        outer = next((e for e in block.elements if _matches(field["within"], e.tag, e.classes)), None)
        if outer is None:
            return [] if field.get("all") else None
        low, high = outer.pos, outer.end
    hits = [e for e in block.elements if low < e.pos < high and _matches(field, e.tag, e.classes)]
    if not field.get("all"):
        return block.text(hits[0].pos, hits[0].end) if hits else None
    # A text belongs to the element that opened last before it, if that is still open.
    begins = [e.pos for e in hits]
    own: list[list[str]] = [[] for _ in hits]
    for at, text in block.texts:
        n = bisect_right(begins, at) - 1
        if n >= 0 and at < hits[n].end:
            own[n].append(text)
    return [" ".join(texts) for texts in own]


def page_blocks(html: str | None, spec: dict) -> list[dict]:
    """One dict of field values for each block of the page, in document order."""
    if not html:
        return []
    return [{name: _field(block, field) for name, field in spec["fields"].items()} for block in _read(html, spec["block"])]
