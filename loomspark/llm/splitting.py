"""Splitting oversized texts at natural boundaries: structure-tree packing with overlap."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest piece and largest overlap with the piece before, in bytes of UTF-8.
LIMIT, OVERLAP = 1200, 100

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
_HEADING = re.compile(r"\s{0,3}(#{1,6})\s")
_ITEM = re.compile(r"(\s*)(?:[-*+]|\d+[.)])\s")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_SENTENCE = re.compile(r"(?<=[.!?;:])[\"')\]]*\s+|(?<=[。！？؟])")
_WORD = re.compile(r"\s+")
# Elements that run inside a line of text, so that their ends are no boundaries of blocks.
_INLINE = frozenset(
    """
    a abbr b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark meter output progress q
    s samp select slot small span strike strong sub sup svg time tt u var wbr
    """.split()
)
_TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)(?:\s[^<>]*?)?(/?)>")
#: Levels of lines that go with what is before them, and of a line before its own subtree.
_WITHIN, _OWN = 1 << 40, 1 << 41
#: What a node may still hold: markup and lines, lines only, neither.
_RAW, _TEXT, _LINE_ONLY = range(3)


class _Node:
    """A span of the text; children, where there are any, cover it without a gap."""

    __slots__ = ("start", "end", "children", "level", "holds")

    def __init__(self, start: int, end: int, level: int = 0, holds: int = _LINE_ONLY):
        self.start, self.end, self.level, self.holds, self.children = start, end, level, holds, []


def _lines(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _LINE.finditer(text, start, end) if m.end() > m.start()]


def _levels(text: str, lines: list[tuple[int, int]]) -> list[int]:
    """The nesting level of each line: headings 0 to 5, else a paragraph, list or code line below them.

    A line is deeper the more it is indented; a blank line and the inside of a fence belong to what is
    before them, so a boundary falls before a heading, an item, a paragraph or an outer block.
    """
    out, fenced, fresh = [], False, True
    for a, b in lines:
        line = text[a:b]
        bare = line.strip()
        if _FENCE.match(line):
            fenced = not fenced
            out.append(8 if fenced else _WITHIN)
            fresh = True
            continue
        if not bare:
            out.append(_WITHIN)
            fresh = not fenced
            continue
        indent = len(line) - len(line.lstrip(" \t")) + 3 * line.count("\t", 0, len(line) - len(line.lstrip()))
        if fenced:
            out.append(14 + indent)
        elif h := _HEADING.match(line):
            out.append(len(h.group(1)) - 1)
        elif _ITEM.match(line):
            out.append(10 + indent)
        elif fresh:
            out.append(7 + min(2, indent))
        else:
            out.append(12 + indent)
        fresh = False
    return out


def _lines_tree(text: str, start: int, end: int) -> list[_Node]:
    """Lines as leaves; each line's subtree runs to the next line of its level or an outer one."""
    lines = _lines(text, start, end)
    root = _Node(start, end, -1)
    stack = [root]
    for (a, b), level in zip(lines, _levels(text, lines)):
        while stack[-1].level >= level:
            stack.pop().end = a
        parent = stack[-1]
        own = _Node(a, b, level)
        if parent is not root and not parent.children and parent.start < a:
            parent.children.append(_Node(parent.start, a, _OWN))
        parent.children.append(own)
        stack.append(own)
    for node in stack:
        node.end = end
    return root.children


def _covering(node: _Node, elements: list[_Node], holds: int) -> None:
    """Makes the elements the children of a node, with nodes of text between them."""
    at = node.start
    for e in elements:
        if at < e.start:
            node.children.append(_Node(at, e.start, holds=holds))
        node.children.append(e)
        at = e.end
    if elements and at < node.end:
        node.children.append(_Node(at, node.end, holds=holds))


def _markup_tree(text: str, start: int, end: int) -> list[_Node]:
    """The elements of a text as a tree, and the text between them; nothing where no block element is closed.

    A start tag without an end and an end tag without a start are text.
    """
    stack: list[tuple[str, int, list[_Node]]] = [("", start, [])]
    for m in _TAG.finditer(text, start, end):
        closing, name, empty = m.group(1), m.group(2).lower(), m.group(3)
        if name in _INLINE or empty:
            continue
        if not closing:
            stack.append((name, m.start(), []))
            continue
        at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
        if at:
            inner = [e for _, _, found in stack[at:] for e in found]
            own = _Node(stack[at][1], m.end(), holds=_TEXT)
            _covering(own, inner, _TEXT)
            del stack[at:]
            stack[-1][2].append(own)
    root = _Node(start, end)
    _covering(root, [e for _, _, found in stack for e in found], _TEXT)
    return root.children


def _grown(text: str, node: _Node) -> list[_Node]:
    """The children of a node, made when they are first asked for."""
    if not node.children and node.holds == _RAW:
        node.children = _markup_tree(text, node.start, node.end)
    if not node.children and node.holds != _LINE_ONLY:
        lines = _lines_tree(text, node.start, node.end)
        # A single line is what it is in.
        node.children = lines if len(lines) > 1 or lines and lines[0].children else []
    return node.children


class _Sizes:
    """Bytes of UTF-8 of any span."""

    def __init__(self, text: str):
        self.ascii = text.isascii()
        if not self.ascii:
            self.at = [0]
            total = 0
            for c in text:
                o = ord(c)
                total += 1 if o < 128 else 2 if o < 2048 else 3 if o < 65536 else 4
                self.at.append(total)

    def __call__(self, a: int, b: int) -> int:
        return b - a if self.ascii else self.at[b] - self.at[a]

    def back(self, a: int, most: int) -> int:
        """The smallest start from which at most `most` bytes lead up to `a`."""
        if self.ascii:
            return max(0, a - most)
        return bisect_left(self.at, self.at[a] - most)

    def ahead(self, a: int, most: int) -> int:
        """The largest end that at most `most` bytes lead to from `a`."""
        if self.ascii:
            return a + most
        i = bisect_left(self.at, self.at[a] + most)
        return i if i < len(self.at) and self.at[i] == self.at[a] + most else i - 1


class _Room:
    """The bytes that a piece beginning at a place may have of its own; only the first one shares none."""

    def __init__(self, limit: int, overlap: int):
        self.first, self.other = limit, limit - overlap

    def __call__(self, start: int) -> int:
        return self.first if start == 0 else self.other


def _parts(text: str, a: int, b: int, size: _Sizes, room: _Room, cuts: tuple = (_SENTENCE, _WORD)) -> list[tuple[int, int]]:
    """A line without structure in parts that fit: sentences, then words, then characters."""
    if not cuts:
        return _characters(a, b, size, room, text)
    ends = [m.end() for m in cuts[0].finditer(text, a, b) if a < m.end() < b]
    spans = list(zip([a, *ends], [*ends, b]))
    return [p for x, y in spans for p in ([(x, y)] if size(x, y) <= room(x) else _parts(text, x, y, size, room, cuts[1:]))]


def _characters(a: int, b: int, size: _Sizes, room: _Room, text: str) -> list[tuple[int, int]]:
    out = []
    while a < b:
        end = min(b, size.ahead(a, room(a)))
        if end < b and text[end - 1] == "\r" and text[end] == "\n" and end - 1 > a:
            end -= 1
        out.append((a, end))
        a = end
    return out


def _pack(node: _Node, text: str, size: _Sizes, room: _Room) -> list[tuple[int, int]]:
    """Pieces of a subtree: whole if it fits; else its children's pieces, with neighbours merged to the limit."""
    done: dict[int, list[tuple[int, int]]] = {}
    order, todo = [], [node]
    while todo:
        n = todo.pop()
        order.append(n)
        if size(n.start, n.end) > room(n.start):
            todo.extend(_grown(text, n))
    for n in reversed(order):
        if size(n.start, n.end) <= room(n.start):
            done[id(n)] = [(n.start, n.end)]
            continue
        parts = [p for c in n.children for p in done.pop(id(c))] if n.children else _parts(text, n.start, n.end, size, room)
        merged: list[tuple[int, int]] = []
        for a, b in parts:
            if merged and size(merged[-1][0], b) <= room(merged[-1][0]):
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        done[id(n)] = merged
    return done[id(node)]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, own start, end) code-point ranges of the pieces of a text.

    The own ranges cover the text without gap or overlap; start is where the shared end of the piece
    before begins: at most `overlap` bytes back, at a line or word boundary where there is one. A piece
    from start to end has at most `limit` bytes. A text within the limit is one piece, an empty text none.
    """
    size = _Sizes(text)
    if not text:
        return []
    if size(0, len(text)) <= limit:
        return [(0, 0, len(text))]
    pieces = _pack(_Node(0, len(text), holds=_RAW), text, size, _Room(limit, overlap))
    out = []
    for a, b in pieces:
        start = a
        if out and overlap:
            low = max(size.back(a, overlap), out[-1][1])
            window = text[low:a]
            at = max(window.rfind("\n", 0, -1), window.rfind("\r", 0, -1)) if len(window) > 1 else -1
            if at < 0:
                m = _WORD.search(window[:-1]) if low > out[-1][1] or low == 0 or not text[low - 1].isspace() else None
                at = m.end() - 1 if m else -1
            start = low + at + 1 if at >= 0 else low
            if start > low and start < a and text[start - 1 : start + 1] == "\r\n":
                start += 1
        out.append((start, a, b))
    return out


SCHEMA = pa.schema([("origin", pa.string()), ("item_id", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("first", pa.int64()), ("shared_bytes", pa.int32()), ("text", pa.string())])
_BREAK = re.compile(r"\r\n|\r|\n")


def _split_batches(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for origin, item, first, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                spans = split_text(text, limit, overlap)
                for k, (a, own, b) in enumerate(spans):
                    at = None if first is None else first + (a if origin == "span" else len(_BREAK.findall(text, 0, a)) - (0 < a < len(text) and text[a - 1] == "\r" and text[a] == "\n"))
                    rows.append((origin, item, k, len(spans), at, len(text[a:own].encode()), text[a:b]))
                if len(rows) > 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), SCHEMA)], schema=SCHEMA)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

    return run


def texts_with_origin(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(origin, item_id, first, text) of chunk contents (first line) and span texts (first code point)."""
    c = chunks.select(F.lit("chunk").alias("origin"), F.col("chunk_id").cast("long").alias("item_id"), F.col("start_line").cast("long").alias("first"), F.col("content").alias("text"))
    s = spans.select(F.lit("span").alias("origin"), F.col("span_id").cast("long").alias("item_id"), F.col("span_start").cast("long").alias("first"), F.col("text").alias("text"))
    return c.unionByName(s)


def split_oversized(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(origin, item_id, piece, pieces, first, shared_bytes, text): the pieces of every text above `limit` bytes.

    `texts` is (origin, item_id, first, text). Elements of markup, headings, lists, code blocks, paragraphs
    and indentation make a tree of any depth; neighbouring subtrees are merged to the limit and only oversized nodes are entered, down
    to sentences, words and at last characters. `first` is the piece's first line, or for origin `span`
    its first code point; null stays null. Pieces share at most `overlap` bytes with the piece before.
    Null, empty and small texts need no cut and give no row; repeated rows give repeated pieces. Sizes
    are compared before Python is started, one text is one unit of work.
    """
    large = texts.select("origin", "item_id", "first", "text").filter(F.octet_length("text") > limit)
    return large.mapInArrow(_split_batches(limit, overlap), "origin string, item_id long, piece int, pieces int, first long, shared_bytes int, text string")


def all_pieces(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every non-empty text: split_oversized, and each smaller text as its only piece."""
    small = texts.filter(F.octet_length("text").between(1, limit)).select(
        "origin", "item_id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.col("first").cast("long"), F.lit(0).alias("shared_bytes"), "text"
    )
    return split_oversized(texts, limit, overlap).unionByName(small)


def oversized_items(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(origin, item_id) of the texts that came out in pieces, each once per row of the text."""
    return split_oversized(texts, limit, overlap).filter("piece = 0").select("origin", "item_id")
