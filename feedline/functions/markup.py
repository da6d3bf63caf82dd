"""HTML text as columns: cleaning, tokens, tags and attributes."""

from __future__ import annotations

import json
from html.entities import html5
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedline.functions.text import strip

# Elements without a closing tag in HTML.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input",
    "link", "meta", "source", "track", "wbr",
)

# One tag with its quoted attributes kept whole.  Possessive, so a long
# document cannot make it backtrack.
TAG = r"""</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
TOKEN = rf"""{TAG}|[^<]++|<"""

HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<![A-Za-z][^>]*>|<\?[^>]*>"
ATTRIBUTE = r"""[\s/]([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


# How anything hidden begins; most pages are only searched for it.
_HIDDEN_START = r"(?i)<(?:[!?]|script|style)"


def visible(html: Column) -> Column:
    """The markup without comments, declarations, scripts and styles."""
    text = F.coalesce(html, F.lit(""))
    return F.when(text.rlike(_HIDDEN_START), F.regexp_replace(text, HIDDEN, "")).otherwise(text)


# Windows-1252 for 128-159; what it leaves undefined stays as it is.
_C1 = [ord(bytes([b]).decode("cp1252", "ignore") or chr(b)) for b in range(128, 160)]

# Names that also count without a semicolon, longest first.
_OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_PARTS = 64


def _named(name: Column) -> Column:
    """The text of a reference's name (with its semicolon, if any), else null."""
    # A map is searched from its start, so the names are dealt to many small ones.
    parts: list[dict[str, str]] = [{} for _ in range(_PARTS)]
    for n, text in html5.items():
        parts[crc32(n.encode()) % _PARTS][n] = text
    table = F.from_json(F.lit(json.dumps(parts)), "array<map<string,string>>")
    return F.try_element_at(F.element_at(table, (F.crc32(name) % _PARTS + 1).cast("int")), name)


def _numbered(piece: Column) -> Column:
    """The character of a numeric reference, by HTML5's rules for numbers that are none."""
    decimal = F.regexp_extract(piece, "^&#0*([0-9]*);?$", 1)
    hexa = F.regexp_extract(piece, "^&#[xX]0*([0-9A-Fa-f]*);?$", 1)
    stated = F.when(piece.rlike("^&#[xX]"), F.conv(F.when(F.length(hexa) < 7, hexa), 16, 10))
    stated = stated.otherwise(F.when(F.length(decimal) < 8, decimal))
    code = F.coalesce(stated.try_cast("bigint"), F.when((decimal == "") & (hexa == ""), 0).otherwise(0x110000))
    none = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    # Control characters and what Unicode keeps free stand for nothing.
    dropped = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF)
    dropped |= code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE
    old = F.try_element_at(F.array(*[F.lit(c) for c in _C1]), (code - 127).cast("int"))
    digits = F.hex(F.when(none, F.lit(0xFFFD)).when(code.between(128, 159), old).otherwise(code).cast("bigint"))
    char = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
    return F.when(none, F.lit("\ufffd")).when(dropped, F.lit("")).otherwise(char)


def unescape(col: Column, attribute: bool = False) -> Column:
    """Decode character references, named or numeric, as HTML5 does.

    In text the longest name that fits counts, and some names need no semicolon.  In
    an attribute one without a semicolon counts only if neither a letter, a digit nor
    an equals sign follows, so that the parameters of a link stay what they are.
    """
    named = "&[A-Za-z][0-9A-Za-z]*+" + ("(?:;|(?!=))" if attribute else ";?")
    reference = f"&#[xX][0-9A-Fa-f]++;?|&#[0-9]++;?|{named}|[^&]++|&"

    def decode(piece: Column) -> Column:
        name = F.substring(piece, F.lit(2), F.length(piece))
        found = _named(name)
        if not attribute:
            start = F.regexp_extract(piece, "^&(" + "|".join(_OPEN_NAMES) + ")", 1)
            rest = F.substring(piece, F.length(start) + 2, F.length(piece))
            found = F.coalesce(found, F.when(start != "", F.concat(_named(start), rest)))
        return F.when(piece.rlike("^&#[0-9xX]"), _numbered(piece)).when(
            piece.rlike("^&[A-Za-z]"), F.coalesce(found, piece)
        ).otherwise(piece)

    pieces = F.regexp_extract_all(col, F.lit(reference), F.lit(0))
    # The most frequent reference, where no other is, needs no table of names.
    amp, only_amp = F.lit("&amp;"), ~F.replace(col, F.lit("&amp;"), F.lit("")).contains("&")
    decoded = F.when(only_amp, F.replace(col, amp, F.lit("&"))).otherwise(F.array_join(F.transform(pieces, decode), ""))
    return F.when(col.contains("&"), decoded).otherwise(col)


def attribute_values(tag: Column, name: str) -> Column:
    """All values of one attribute in a tag, decoded, in order."""
    # Most tags that are looked at have this attribute alone, in quotes and without references.
    alone = rf"""^<[A-Za-z][0-9A-Za-z]*\s+(?i:{name})="([^"&]*+)"\s*>\z"""
    pattern = F.lit(ATTRIBUTE)
    pairs = F.arrays_zip(
        F.regexp_extract_all(tag, pattern, F.lit(1)).alias("name"),
        F.regexp_extract_all(tag, pattern, F.lit(2)).alias("value"),
    )
    named = F.filter(pairs, lambda p: F.lower(p["name"]) == name)
    values = F.transform(
        named, lambda p: unescape(F.regexp_replace(p["value"], r"""(?s)^(["'])(.*)\1$""", "$2"), attribute=True)
    )
    return F.when(tag.rlike(alone), F.array(F.regexp_extract(tag, alone, 1))).otherwise(values)


def class_tokens(tag: Column) -> Column:
    """The class names of a tag."""
    value = F.coalesce(F.get(attribute_values(tag, "class"), F.lit(0)), F.lit(""))
    return F.filter(F.split(value, r"\s+"), lambda c: c != "")


def tag_name(token: Column) -> Column:
    """Lower-cased element name of an opening or closing tag, else empty."""
    return F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))


def html_text(html: Column) -> Column:
    """Text nodes stripped, empty ones dropped, joined by one space."""
    nodes = F.split(F.regexp_replace(visible(html), TAG, "\u0001"), "\u0001")
    texts = F.transform(nodes, lambda n: strip(unescape(n)))
    return F.when(html.isNotNull(), F.array_join(F.filter(texts, lambda t: t != ""), " "))


def hrefs(html: Column) -> Column:
    """Every non-empty ``href`` of the anchors, in document order."""
    anchors = F.regexp_extract_all(
        visible(html), F.lit(r"""<[aA](?:\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+)?>"""), F.lit(0)
    )
    found = F.flatten(F.transform(anchors, lambda a: attribute_values(a, "href")))
    return F.filter(found, lambda h: h != "")


def page_count(html: Column) -> Column:
    """Highest page the pager offers, 1 without a pager."""
    pages = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"page=([0-9]+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(pages, lambda p: p.try_cast("bigint"))), F.lit(1).cast("bigint"))
