"""Price documents of the usual plain shape, read many at once as columns.

A document is plain if it is tags and texts only: a root, its leaves, one ``Items``
with items of one known tag, and their leaves; no comments, CDATA, references beyond
the five of XML, no attributes but of the root and ``Items``, no two aliases of a field
in one item.  The tags of a slice of documents are found, matched and numbered as
arrays, so a document costs nothing of its own.  Whatever is in any way different, also
every document that is not well-formed, is left to the XML parser.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*"
_DECLARATION = re.compile(
    rb"""\?xml\s+version\s*=\s*["']1\.0["'](?:\s+encoding\s*=\s*["'][A-Za-z][A-Za-z0-9._-]*["'])?"""
    rb"""(?:\s+standalone\s*=\s*["'](?:yes|no)["'])?\s*\?"""
)
_OPENING = re.compile(rf"""({_NAME})((?:[ \t\r\n]+{_NAME}[ \t\r\n]*=[ \t\r\n]*(?:"[^"<>&]*"|'[^'<>&]*'))*)[ \t\r\n]*(/?)""")
_ATTRIBUTE = re.compile(rf"""({_NAME})[ \t\r\n]*=""")
_CLOSING = re.compile(rf"/({_NAME})[ \t\r\n]*")
_REFERENCE = re.compile(rb"&(?:amp|lt|gt|quot|apos);")
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))

# The bytes that are looked at: "<", ">", "&" and what is no printable character.
_MARKED = np.zeros(256, bool)
_MARKED[[0x3C, 0x3E, 0x26, *(b for b in range(32) if b not in (9, 10))]] = True

_OPEN, _CLOSE, _EMPTY, _OTHER = 0, 1, 2, 3
# Longer names are left to the parser, whose check of the end looks at some 200 characters.
_LONGEST = 100


def _between(data: pa.Buffer, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """Texts of ascending places of a buffer; at twice its number each, the gaps between."""
    edges = np.empty(2 * len(starts), np.int32)
    edges[0::2], edges[1::2] = starts, ends
    if not len(edges):
        return pa.array([], pa.string())
    return pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), data)


def _places(positions: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether any of the ascending positions lies in a place."""
    return np.searchsorted(positions, ends) > np.searchsorted(positions, starts)


class PlainPrices:
    """Reads plain documents; ``fields`` has the accepted tags of every field, in order."""

    def __init__(self, fields: list[tuple[str, ...]], item_tags: tuple[str, ...], head: tuple[str, ...], white: str) -> None:
        self.n_fields, self.head, self.white = len(fields), [tag.lower() for tag in head], white
        self.items = {tag.lower(): n for n, tag in enumerate(item_tags)}
        self.aliases = {tag.lower(): (n, f) for n, (f, tag) in enumerate((f, tag) for f, tags in enumerate(fields) for tag in tags)}
        self.doubled = [[self.aliases[tag.lower()][0] for tag in tags] for tags in fields if len(tags) > 1]

    def _tags(self, found: list[str]) -> tuple[np.ndarray, ...]:
        """Of distinct tags: kind, number of the name, alias, field, item tag, head (-2 for ``Items``), attributes."""
        names: dict[str, int] = {}
        rows = np.full((7, len(found)), -1, np.int32)
        rows[0], rows[6] = _OTHER, 0
        for n, tag in enumerate(found):
            closing = _CLOSING.fullmatch(tag)
            opening = None if closing else _OPENING.fullmatch(tag)
            name = (closing or opening or [None, ""])[1]
            if not name or len(name) > _LONGEST or (low := name.lower()) == "_corrupt":
                continue
            if opening and opening[2]:
                stated = [a.lower() for a in _ATTRIBUTE.findall(re.sub(r""""[^"]*"|'[^']*'""", "", opening[2]))]
                if len(set(stated)) < len(stated) or any(a.startswith("xml") or a == "corrupt" for a in stated):
                    continue
                rows[6, n] = 1
            rows[0, n] = _CLOSE if closing else _EMPTY if opening[3] else _OPEN
            rows[1, n] = names.setdefault(name, len(names))
            rows[2, n], rows[3, n] = self.aliases.get(low, (-1, -1))
            rows[4, n] = self.items.get(low, -1)
            rows[5, n] = -2 if low == "items" else self.head.index(low) if low in self.head else -1
        return tuple(rows)

    def read(self, docs: pa.StringArray) -> tuple[np.ndarray, np.ndarray, list[pa.Array], list[pa.Array]]:
        """Whether each document is plain; of all items of these the document, and the texts of each field; of each document the head texts."""
        n = len(docs)
        offsets = np.frombuffer(docs.buffers()[1], np.int32)[docs.offset : docs.offset + n + 1]
        data = docs.buffers()[2] if offsets[-1] > offsets[0] else pa.py_buffer(b" ")
        whole = np.frombuffer(data, np.uint8)
        base, buf = offsets[0], whole[offsets[0] : offsets[-1]]
        starts, ends = offsets[:-1], offsets[1:]
        ok = ends > starts

        def documents_of(places: np.ndarray) -> np.ndarray:
            return np.searchsorted(ends, places, side="right")

        marks = np.flatnonzero(_MARKED[buf]).astype(np.int32) + base
        byte = whole[marks]
        control = (byte < 32) & (byte != 13)
        if control.any():
            ok[documents_of(marks[control])] = False
        if len(buf) and buf.max() > 127:
            for d in np.unique(documents_of(np.flatnonzero(buf > 127) + base)):
                raw = whole[starts[d] : ends[d]].tobytes()
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    ok[d] = False
                if b"\xef\xbf\xbe" in raw or b"\xef\xbf\xbf" in raw:
                    ok[d] = False
        references = marks[byte == 0x26]
        for d in np.unique(documents_of(references)):
            raw = whole[starts[d] : ends[d]].tobytes()
            ok[d] &= raw.count(b"&") == len(_REFERENCE.findall(raw))

        # Tags: from each "<" to the next ">", with no other of them between.
        lt, gt = marks[byte == 0x3C], marks[byte == 0x3E]
        n_lt, n_gt = (np.searchsorted(m, ends) - np.searchsorted(m, starts) for m in (lt, gt))
        ok &= (n_lt == n_gt) & (n_lt > 1)
        if not ok.all():
            lt, gt = lt[np.repeat(ok, n_lt)], gt[np.repeat(ok, n_gt)]
        of = np.repeat(np.flatnonzero(ok).astype(np.int32), n_lt[ok])
        wrong = lt > gt
        wrong[1:] |= (gt[:-1] > lt[1:]) & (of[:-1] == of[1:])

        def keep_good(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
            if wrong.any():
                ok[of[wrong]] = False
                good = ok[of]
                return tuple(a[good] for a in arrays)
            return arrays

        of, lt, gt = keep_good(of, lt, gt)
        # A declaration may stand at the very start.
        before = starts.copy()
        stated = np.flatnonzero(whole[lt + 1] == 0x3F) if len(lt) else lt
        if len(stated):
            wrong, declared = np.zeros((2, len(of)), bool)
            for t in stated:
                fine = lt[t] == starts[of[t]] and _DECLARATION.fullmatch(whole[lt[t] + 1 : gt[t]].tobytes())
                (declared if fine else wrong)[t] = True
            before[of[declared]] = gt[declared] + 1
            ok[of[wrong]] = False
            kept = ~declared & ok[of]
            of, lt, gt = of[kept], lt[kept], gt[kept]

        if len(lt):
            named = _between(data, lt + 1, gt).take(pa.array(np.arange(0, 2 * len(lt), 2, dtype=np.int32))).dictionary_encode()
            number = named.indices.to_numpy(zero_copy_only=False)
            kinds, names, aliases, fields, item_tags, heads, attributes = self._tags(named.dictionary.to_pylist())
        else:
            number = lt
            kinds = names = aliases = fields = item_tags = heads = attributes = np.zeros(1, np.int32)
        kind = kinds.astype(np.int8)[number]
        wrong = kind == _OTHER

        # Levels: a root that ends at the end, and what opens at one closes there under its name.
        total = np.cumsum((kind == _OPEN).view(np.int8) - (kind == _CLOSE).view(np.int8), dtype=np.int32)
        end = np.ones(len(of), bool)
        end[:-1] = of[1:] != of[:-1]
        new = np.ones(len(of), bool)
        new[1:] = end[:-1]
        begun = np.flatnonzero(new)
        held = np.diff(np.append(begun, len(of)))
        after = total - np.repeat(total[begun] - (kind[begun] == _OPEN) + (kind[begun] == _CLOSE), held)
        level = after + (kind != _OPEN)
        wrong |= (level < 1) | (level > 4) | ((after == 0) != end) | (new & (kind != _OPEN))
        of, lt, gt, number, kind, level, end, new = keep_good(of, lt, gt, number, kind, level, end, new)
        wrong = np.zeros(len(of), bool)

        # A leaf is opened and closed by two tags in turn; other places between tags are blank.
        leaf = np.zeros(len(of), bool)
        leaf[:-1] = ~end[:-1] & (kind[:-1] == _OPEN) & (kind[1:] == _CLOSE)
        name = names[number]
        wrong[:-1] |= leaf[:-1] & (name[:-1] != name[1:])
        text_end = np.empty(len(of), np.int32)
        text_end[:-1] = lt[1:]
        text_end[end] = ends[of[end]]
        gap = np.flatnonzero(~leaf & (text_end > gt + 1))
        if len(gap):
            wrong[gap] |= self._bounds(data, gt[gap] + 1, text_end[gap], " \t\r\n")[1] > 0
        lead = np.flatnonzero(new)
        lead = lead[lt[lead] > before[of[lead]]]
        if len(lead):
            wrong[lead] |= self._bounds(data, before[of[lead]], lt[lead], " \t\r\n")[1] > 0
        wrong |= (attributes[number] > 0) & (level > 2)

        # What is no leaf's closing tag and no leaf of an item: roots, their children and items.
        outer = np.flatnonzero((level < 4) & (kind != _CLOSE))
        closing = np.flatnonzero((level < 4) & (kind == _CLOSE))
        depth, o_of, o_number = level[outer], of[outer], number[outer]
        for d in range(1, 4):
            opened, closed = outer[(depth == d) & (kind[outer] == _OPEN)], closing[level[closing] == d]
            wrong[opened] |= name[opened] != name[closed]
        container = (depth == 2) & (heads[o_number] == -2)
        empty, plain = kind[outer] == _EMPTY, leaf[outer]
        bad = (container & empty) | ((depth == 2) & ~plain & ~empty & ~container)
        bad |= (depth == 3) & ((item_tags[o_number] < 0) | empty | plain) | ((depth == 1) & plain)
        bad |= (depth == 2) & ~container & (attributes[o_number] > 0)
        listed = np.flatnonzero(container & plain)
        if len(listed):
            t = outer[listed]
            bad[listed] |= self._bounds(data, gt[t] + 1, text_end[t], " \t\r\n")[1] > 0
        wrong[outer] |= bad
        ok[np.bincount(o_of[container], minlength=n) > 1] = False
        is_item = depth == 3
        items, item_of = outer[is_item], o_of[is_item]
        # One tag for all items of a document.
        tagged = np.zeros((n, len(self.items)), bool)
        tagged[item_of, item_tags[o_number[is_item]]] = True
        ok[tagged.sum(axis=1) > 1] = False

        value = np.flatnonzero((level == 4) & (kind != _CLOSE))
        alias = aliases[number[value]]
        value, alias = value[alias >= 0], alias[alias >= 0]
        of_item = np.searchsorted(items, value) - 1
        present = np.zeros((len(items), len(self.aliases)), bool)
        present[of_item, alias] = True
        for tags in self.doubled:
            ok[item_of[present[:, tags].sum(axis=1) > 1]] = False
        headed = outer[(depth == 2) & (heads[o_number] >= 0) & plain]
        told = np.zeros(len(of), bool)
        told[value] = leaf[value]
        told[headed] = True
        returns = marks[byte == 13]
        if len(returns):
            wrong |= told & _places(returns, gt + 1, text_end)
        ok[of[wrong]] = False

        # Texts: without white space at their ends, blank ones are none; the first of each field counts.
        if not ok.all():
            told &= ok[of]
        t = np.flatnonzero(told)
        begin, length = gt[t] + 1, text_end[t] - gt[t] - 1
        edges = np.flatnonzero(length > 0)
        outside = whole[begin[edges]], whole[begin[edges] + length[edges] - 1]
        shown = (outside[0] > 32) & (outside[0] < 127) & (outside[1] > 32) & (outside[1] < 127)
        rest = edges[~shown]
        if len(rest):
            begin[rest], length[rest] = self._bounds(data, begin[rest], begin[rest] + length[rest], self.white)
        texts = _between(data, begin, begin + length)
        stated = np.flatnonzero(length > 0)[::-1]
        tag = t[stated]
        kept = ok[item_of]
        inner = level[tag] == 4
        chosen = np.full((int(kept.sum()), self.n_fields), -1, np.int32)
        place = (np.cumsum(kept) - 1)[np.searchsorted(items, tag[inner]) - 1]
        chosen[place, fields[number[tag[inner]]]] = stated[inner]
        headings = np.full((n, len(self.head)), -1, np.int32)
        headings[of[tag[~inner]], heads[number[tag[~inner]]]] = stated[~inner]

        def column(places: np.ndarray) -> pa.Array:
            found = texts.take(pa.array(2 * places, pa.int32(), mask=places < 0))
            if len(references) and pc.any(pc.match_substring(found, "&")).as_py():
                for reference, char in _REFERENCES:
                    found = pc.replace_substring(found, reference, char)
            return found

        return (
            ok, item_of[kept], [column(chosen[:, f]) for f in range(self.n_fields)], [column(headings[:, h]) for h in range(len(self.head))]
        )

    @staticmethod
    def _bounds(data: pa.Buffer, starts: np.ndarray, ends: np.ndarray, white: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of texts without ``white`` at their ends."""
        texts = _between(data, starts, ends).take(pa.array(np.arange(0, 2 * len(starts), 2, dtype=np.int32)))
        led = pc.utf8_ltrim(texts, white)
        start = ends - pc.binary_length(led).to_numpy(zero_copy_only=False)
        return start, pc.binary_length(pc.utf8_rtrim(led, white)).to_numpy(zero_copy_only=False).astype(np.int64)
