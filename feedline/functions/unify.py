"""Feed documents written anew with one name for each thing, for those the schema alone cannot read.

``from_xml`` groups children by tag, so it loses the order of children under several
tags and does not see tags a schema does not name.  The few documents where that
matters are written anew here, in one pass that is linear in their length, and then
parsed like any other.  The functions take null for documents that need nothing.
"""

from __future__ import annotations

from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import functions as F

# What an element is for a reader of the document: its role and the name it gets.
Role = tuple[str | None, str]


class _Writer:
    """Writes the elements of a document into one or more texts; ``stack`` has the open ones of each."""

    def __init__(self) -> None:
        self.stack: list[list[tuple[list[str], str | None, str]]] = []
        self.parser = expat.ParserCreate()
        self.parser.StartElementHandler = self.start
        self.parser.EndElementHandler = self.end
        self.parser.CharacterDataHandler = self.text
        self.parser.buffer_text = True

    def places(self, local: str, name: str) -> list[tuple[list[str], str | None, str]]:
        """For a new element: the texts it goes into, and its role and name in each."""
        raise NotImplementedError

    def start(self, name: str, attributes: dict) -> None:
        tags = self.places(name.rpartition(":")[2].lower(), name)
        if tags:
            stated = "".join(f" {k}={quoteattr(v)}" for k, v in attributes.items())
            for text, _, called in tags:
                text.append(f"<{called}{stated}>")
        self.stack.append(tags)

    def end(self, name: str) -> None:
        for text, _, called in self.stack.pop():
            text.append(f"</{called}>")

    def text(self, data: str) -> None:
        if self.stack and self.stack[-1]:
            shown = escape(data)
            for text, _, _ in self.stack[-1]:
                text.append(shown)


class _Prices(_Writer):
    """Children of the root's first ``items`` become ``item``; field aliases the first of them."""

    def __init__(self, item: str, aliases: dict[str, str]) -> None:
        super().__init__()
        self.whole: list[str] = []
        self.item, self.aliases, self.found = item, aliases, False

    def places(self, local, name):
        role, called = None, name
        above = self.stack[-1][0][1] if self.stack else None
        if len(self.stack) == 1 and local == "items" and not self.found:
            role, self.found = "items", True
        elif above == "items":
            role, called = "item", self.item
        elif above == "item":
            called = self.aliases.get(local, name)
        return [(self.whole, role, called)]

    def document(self) -> str:
        return "".join(self.whole)


class _Promotions(_Writer):
    """Promotions of any depth one after another below a root; their items under one tag.

    A promotion inside another is one of its own and no part of the other, unless it
    stands among the other's items: then it is an item there as well.
    """

    def __init__(self, item: str, aliases: dict[str, str]) -> None:
        super().__init__()
        self.item, self.aliases = item, aliases
        self.head: list[str] = []
        self.promotions: list[list[str]] = []

    def role(self, above: str | None, local: str, name: str) -> Role:
        if above == "items":
            return "item", self.item
        if above in ("promotion", "group") and local == "promotionitems":
            return "items", name
        if above == "promotion":
            return ("groups" if local == "groups" else None), self.aliases.get(local, name)
        return ("group" if above == "groups" and local == "group" else None), name

    def places(self, local, name):
        above = self.stack[-1] if self.stack else []
        found = [(text, *self.role(role, local, name)) for text, role, _ in above if text is not self.head]
        if local == "promotion":
            own: list[str] = []
            self.promotions.append(own)
            found = [f for f in found if f[1] == "item"] + [(own, "promotion", "Promotion")]
        if len(self.stack) == 1 and local in ("chainid", "storeid"):
            found.append((self.head, None, name))
        return found

    def document(self) -> str:
        return "".join(["<Root>", *self.head, *("".join(p) for p in self.promotions), "</Root>"])


def _unifier(kind: type[_Writer], item: str, aliases: list[tuple[str, ...]]):
    named = {tag.lower(): tags[0] for tags in aliases for tag in tags}

    @F.arrow_udf("doc string, error string")
    def unified(docs: pa.Array) -> pa.Array:
        texts, errors = [], []
        for doc in docs:
            text, error = None, None
            if doc.is_valid:
                try:
                    writer = kind(item, named)
                    writer.parser.Parse(doc.as_py(), True)
                    text = writer.document()
                except expat.ExpatError as refused:
                    error = str(refused)
            texts.append(text)
            errors.append(error)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["doc", "error"])

    return unified


def unified_prices(item: str, aliases: list[tuple[str, ...]]):
    """A function of a document column: ``doc``, the price document with one item tag, and ``error``."""
    return _unifier(_Prices, item, aliases)


def unified_promotions(item: str, aliases: list[tuple[str, ...]]):
    """A function of a document column: ``doc``, its promotions below one root, and ``error``."""
    return _unifier(_Promotions, item, aliases)
