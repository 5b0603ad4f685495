"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8): a tokenization automaton.

The automaton reads tokens; its states are the tokens last read.  It is compiled from the rank file by
successive merge gadgets: in order of rank, the merge (a, b) -> c adds the arc c and blocks b behind
every state that ends in a.  A sequence of tokens is the encoding of its bytes exactly if the automaton
reads it.  The gadgets are kept as two split tables (left and right part of each token); whether an arc
is blocked is worked out from them at first use and then kept in the transition table, as a table of
all 50,000 x 50,000 arcs would be useless.

The automaton is deterministic: behind each prefix of a word there is one state, the last token of that
prefix's encoding.  A word is encoded in one pass over its bytes: a pattern automaton of all tokens
names those that end at each byte, longest first, and the one whose arc is open in the state where it
begins is the next state.  Nothing is ever taken back.  Following the states from the end gives the
encoding.  Decoding emits the bytes that label the arcs.

Texts are split by the tokenizer's own pattern, first at white space into coarse pieces (a run of white
space with what follows), which is exact since no word crosses from other characters into white space.
Pieces and words are looked up in bounded caches.

Defined cases: null and empty texts give an empty list; special tokens' strings are ordinary text; lone
surrogates are read as the replacement character.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwell.llm.texts import slices

BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: the pattern that splits text before the merges of the rank files (the tokenizer's own)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: white space as the pattern's \s means it
_SPACE = "\t-\r \x85\xa0  -     　"
_COARSE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: entries that a cache holds before it is emptied
CACHE = 200_000
#: a piece longer than this isn't kept
CACHED_LENGTH = 64


def rank_file(name: str = BYTE_BPE_50K) -> str:
    """Where the public tokenizers' files lie here; pass a path to use others."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Automaton:
    """The tokenization automaton of one rank file."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.labels = {i: b for b, i in self.ids.items()}
        self.size = {i: len(b) for b, i in self.ids.items()}
        #: all tokens, read as characters of one byte
        self.tokens = ahocorasick.Automaton()
        for label, c in self.ids.items():
            self.tokens.add_word(label.decode("latin-1"), c)
        self.tokens.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        for label, c in sorted(self.ids.items(), key=lambda x: x[1]):
            self._gadget(label, c)
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _gadget(self, label: bytes, c: int) -> None:
        """The gadget of one token: its parts are the two tokens that are read instead without it."""
        if len(label) == 1:
            self.left[c] = self.right[c] = c
            return
        parts = self._read(label, below=c)
        if len(parts) != 2:
            raise ValueError(f"token {c} isn't the merge of two tokens before it")
        self.left[c], self.right[c] = parts
        self.merged[parts[0], parts[1]] = c

    def open(self, u: int, v: int) -> bool:
        """Whether the arc v is open in state u."""
        known = self.arcs.get((u, v))
        if known is None:
            if len(self.arcs) > 4 * CACHE:
                self.arcs.clear()
            known = self.arcs[u, v] = self._unblocked(u, v)
        return known

    def _rank(self, t: int) -> int:
        return t if self.left[t] != t else -1

    def _unblocked(self, u: int, v: int) -> bool:
        """No gadget merges across the seam of u and v before the later of the tokens at the seam arose:
        the seam is taken back in time, undoing the latest merge on either side."""
        before = 1 << 60
        while True:
            c = self.merged.get((u, v))
            if c is not None and c < before:
                return False
            ru, rv = self._rank(u), self._rank(v)
            if ru < 0 and rv < 0:
                return True
            if ru > rv:  # undone first: of equal merges the one on the left arises first
                before, u = ru, self.right[u]
            else:
                before, v = rv + 1, self.left[v]

    def _read(self, word: bytes, below: int | None = None) -> list[int]:
        """The path whose labels spell ``word``; with ``below``, of the automaton before that token."""
        n = len(word)
        state = [-1] * (n + 1)
        size, is_open = self.size, self.open if below is None else self._unblocked
        for end, t in self.tokens.iter(word.decode("latin-1")):
            if state[end + 1] >= 0:
                continue
            k = size[t]
            if below is not None and t >= below and k > 1:
                continue
            start = end + 1 - k
            if not start or state[start] >= 0 and is_open(state[start], t):
                state[end + 1] = t
        path, at = [], n
        while at:
            t = state[at]
            if t < 0:
                raise ValueError("no path: the rank file lacks a byte")
            path.append(t)
            at -= size[t]
        return path[::-1]

    def word(self, w: str) -> tuple[int, ...]:
        known = self.words.get(w)
        if known is None:
            b = w.encode("utf-8", "replace")
            t = self.ids.get(b)
            known = (t,) if t is not None else tuple(self._read(b))
            if len(w) <= CACHED_LENGTH:
                if len(self.words) >= CACHE:
                    self.words.clear()
                self.words[w] = known
        return known

    def _piece(self, p: str) -> tuple[int, ...]:
        words = self.split(p)
        out = self.word(words[0]) if len(words) == 1 else tuple(i for w in words for i in self.word(w))
        if len(p) <= CACHED_LENGTH:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            self.pieces[p] = out
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get, add = self.pieces.get, out.extend
        for p in _COARSE.findall(text):
            add(get(p) or self._piece(p))
        return out

    def count(self, text: str) -> int:
        get = self.pieces.get
        return sum([len(get(p) or self._piece(p)) for p in _COARSE.findall(text)])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_automata: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """One automaton per process and file."""
    if path not in _automata:
        _automata[path] = Automaton(path)
    return _automata[path]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every row, in the order and partitions of the scan: no shuffle."""
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for whole in batches:
            for b in slices(whole, [1]):
                ids = [a.encode(t) if t else [] for t in b.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens) of every row."""
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for b in batches:
            n = [a.count(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text) of every row; an empty list gives an empty text, a null one a null."""
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for b in batches:
            texts = [None if x is None else a.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = dict(encoded.dtypes)[key]
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
