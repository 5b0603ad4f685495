"""Cutting oversized texts at natural boundaries (problem 1): structure-tree packing.

A text is parsed into a tree: sections under headings (numbered, named, of markup or in capitals), blocks
parted by blank lines or the ends of markup's blocks, list items with the lines that belong to them,
lines, sentences, words.  A node that fits is a unit.  A larger one is replaced by
the packing of its children: sibling units are merged from the left while they fit, and only nodes that
are too large are descended into.  A run without any natural boundary longer than the limit is cut by
force.  Each piece starts with up to ``overlap`` last characters of the one before, from a word start.

Defined cases: null, empty and short texts (at most ``limit`` characters) come out whole as one piece,
null ones as none; rows without a key
are kept, those of one source as one in ``oversized``; positions are code points of the text as stored, and the bodies of the pieces
(``start`` to ``stop``) part the text without a gap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnwell.llm.texts import slices

LIMIT, OVERLAP = 2_000, 200

#: words that name headings, in the languages of the corpus; pass others for others
NAMES = (
    "appendix chapter figure part section table abbildung abschnitt anhang kapitel tabelle teil annexe chapitre partie tableau "
    "anexo capítulo parte sección tabla глава раздел таблица"
).split()

_BLANK = re.compile(r"\n[^\S\n]*\n\s*|</(?:p|div|section|article|ul|ol|li|table|tr|h[1-6])>\s*", re.I)
_HEADING = re.compile(rf"(?:#{{1,6}}\s|<h([1-6])\b|(?:{'|'.join(NAMES)})\s+\d+|(\d+(?:\.\d+)*)\.?\s+\S)", re.I)
_ITEM = re.compile(r"^[^\S\n]*(?:[-*•‣◦▪–]|\(?\d{1,3}[.)]|\(?[a-zA-Z]\)|<li\b[^>]*>)[^\S\n]*(?=\S)", re.M)
_LINE_END = re.compile(r"\n\s*")
_SENTENCE = re.compile(r"[.!?。！？]+[\"'”’»)\]]*\s*")
#: where a word ends: behind white space, or behind a mark that ends a sentence
_WORD = re.compile(r"[^\s.!?。！？]*(?:[.!?。！？]|\s+|$)")

PARAGRAPH, LINE, SENTENCE, WORD, FORCED = "paragraph", "line", "sentence", "word", "forced"
#: kinds of boundary, from the finest to the coarsest
ORDER = (FORCED, WORD, SENTENCE, LINE, PARAGRAPH)


def _cuts(pattern: re.Pattern, text: str, a: int, b: int) -> list[tuple[int, int]]:
    """[a, b) parted behind every match of ``pattern``."""
    out, at = [], a
    for m in pattern.finditer(text, a, b):
        if at < m.end() < b:
            out.append((at, m.end()))
            at = m.end()
    if at < b:
        out.append((at, b))
    return out


def _level(text: str, a: int, b: int) -> int | None:
    """Level of the heading that [a, b) consists of, else None."""
    s = text[a:b].strip()
    if not s or len(s) > 120 or "\n" in s or s[-1] in ".!?;,":
        return None
    m = _HEADING.match(s)
    if m:
        if m.group(1):
            return int(m.group(1))
        return m.group(2).count(".") + 1 if m.group(2) else (len(s) - len(s.lstrip("#"))) or 0
    return 0 if s.isupper() and len(s) > 8 else None


def _sections(text: str, blocks: list[tuple[int, int]]) -> list:
    """Blocks as a forest by heading levels: a heading and what follows it, down to the next heading of
    its level or above, are one node.  A node is (start, stop, children)."""
    root: list = [0, len(text), [], -1]
    path = [root]
    for a, b in blocks:
        level = _level(text, a, b)
        leaf = [a, b, [], None]
        if level is not None:
            while path[-1][3] >= level:
                path.pop()
            node = [a, b, [leaf], level]
            path[-1][2].append(node)
            path.append(node)
        else:
            path[-1][2].append(leaf)
        for open_node in path:
            open_node[1] = max(open_node[1], b) if open_node is not root else len(text)
    return root[2]


def _parts(text: str, a: int, b: int, depth: int) -> tuple[list[tuple[int, int]], str]:
    if depth == 0:
        starts = [m.start() for m in _ITEM.finditer(text, a, b) if m.start() > a and text[m.start() - 1] == "\n"]
        return list(zip([a, *starts], [*starts, b], strict=True)), LINE
    if depth == 1:
        return _cuts(_LINE_END, text, a, b), LINE
    if depth == 2:
        return _cuts(_SENTENCE, text, a, b), SENTENCE
    return _cuts(_WORD, text, a, b), WORD


def _merge(units: list[tuple[int, int, str]], room: int) -> list[tuple[int, int, str]]:
    """Merge neighbours from the left while they fit; a unit ends with its last part's boundary."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in units:
        if out and b - out[-1][0] <= room:
            out[-1] = (out[-1][0], b, kind)
        else:
            out.append((a, b, kind))
    return out


def _pack_span(text: str, a: int, b: int, end: str, depth: int, room: int, limit: int) -> list[tuple[int, int, str]]:
    if b - a <= room:
        return [(a, b, end)]
    if depth > 3:  # one word
        if b - a <= limit:
            return [(a, b, end)]
        core = a + len(text[a:b].rstrip())
        if core > a and text[core - 1] in ".!?。！？":
            core -= 1
        if core - a <= limit:  # only the mark or the white space behind it is too much
            head = [(a, core, WORD)] if core > a else []
            return head + [(x, min(x + room, b), WORD if x + room < b else end) for x in range(core, b, room)]
        cuts = [*range(a, core, room), b]
        if b - cuts[-2] > limit:
            cuts.insert(-1, core)
        return [(x, y, FORCED if y < core else end) for x, y in zip(cuts, cuts[1:], strict=False)]
    units: list[tuple[int, int, str]] = []
    spans, kind = _parts(text, a, b, depth)
    for x, y in spans:
        units += _pack_span(text, x, y, end if y == b else kind, depth + 1, room, limit)
    return _merge(units, room)


def _pack_node(text: str, node: list, room: int, limit: int) -> list[tuple[int, int, str]]:
    a, b, children, _ = node
    if b - a <= room:
        return [(a, b, PARAGRAPH)]
    if not children:
        return _pack_span(text, a, b, PARAGRAPH, 0, room, limit)
    units: list[tuple[int, int, str]] = []
    for c in children:
        units += _pack_node(text, c, room, limit)
    return _merge(units, room)


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(head, start, stop, kind) of every piece: the piece is text[head:stop], its overlap ends at
    ``start``, and ``kind`` says what it ends with."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    if len(text) <= limit:
        return [(0, 0, len(text), PARAGRAPH)]
    units = []
    for node in _sections(text, _cuts(_BLANK, text, 0, len(text))):
        units += _pack_node(text, node, limit - overlap, limit)
    out: list[tuple[int, int, int, str]] = []
    for a, b, kind in _merge(units, limit - overlap):
        head = a
        if out:
            low = max(out[-1][0], a - overlap, b - limit)
            # from the first word start in reach; none means that nothing is repeated
            starts = re.compile(r"(?<=[\s.!?。！？])[^\s.!?。！？]")
            m = starts.search(text, low, a)
            head = m.start() if m else (low if out[-1][3] == FORCED else a)
        out.append((head, a, b, kind))
    return out


def split_oversized(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, bodies: bool = True) -> DataFrame:
    """One row per piece of every text of (src, id, text) above ``limit``: (src, id, piece_no, head,
    start, stop, ends_with, piece).  Without ``bodies`` the pieces' characters are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, [2])):
            rows = [
                (src, i, n, h, x, y, k, text[h:y] if bodies else None)
                for src, i, text in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True)
                for n, (h, x, y, k) in enumerate(pieces(text, limit, overlap))
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["src", "id", "piece_no", "head", "start", "stop", "ends_with", "piece"])

    schema = "src string, id bigint, piece_no int, head int, start int, stop int, ends_with string, piece string"
    return texts.select("src", "id", "text").where(F.length("text") > limit).mapInArrow(run, schema)


def oversized(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(src, row_id, kind) of every oversized text: ``forced`` if its packing had to cut inside a word."""
    p = split_oversized(texts, limit, overlap, bodies=False)
    forced = F.max((F.col("ends_with") == FORCED).cast("int")) == 1
    return p.groupBy("src", F.col("id").alias("row_id")).agg(F.when(forced, "forced").otherwise("boundary").alias("kind"))
