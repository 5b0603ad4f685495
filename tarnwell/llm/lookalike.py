"""One consistent form for texts that show the same (problem 2).

Look-alike classes are built by union-find over *strings*: code points, and the sequences that show
like one of them.  Links come from four rules (full-width and ligature decompositions, kinds of space,
invisible characters, canonical composition) and one fixed list of look-alike letters.  Unions are
transitive, so a full-width Latin ``a`` and a Cyrillic one meet in the class of ``a``.  The
representative of a class is its most frequent member, by counts of code points over the whole corpus.
Texts are rewritten greedily, longest match first, by a multi-pattern automaton, until nothing
matches; the result is in composed form.

Null texts give null, empty texts give empty ones.  Case, punctuation, digits, superscripts and
accents are kept: they show.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tarnwell.runtime import cut

# Cyrillic and Greek letters and signs that show like the letter below them.
LOOKS = {
    "АВЕЅІЈКМНОРСТХУԚԜ": "ABESIJKMHOPCTXYQW",
    "аеѕіјорсухһԁԛԝӏ": "aesijopcyxhdqwl",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "ο": "o",
    "µ": "μ",
    "Ω": "Ω",
    "K": "K",
    "Å": "Å",
}
#: General categories whose members print nothing, except white space and combining marks.
INVISIBLE = {"Cf"}
#: Control characters that lay text out; they show.
LAYOUT = set("\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u2028\u2029")
_SHOWN_APART = {"super", "sub", "fraction", "circle", "square", "font"}


class Classes:
    """Union-find over strings with frequency-based representatives."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.parent: dict[str, str] = {}

    def find(self, s: str) -> str:
        p = self.parent.setdefault(s, s)
        while p != s:
            self.parent[s] = self.parent.setdefault(p, p)
            s, p = p, self.parent[p]
        return s

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def frequency(self, s: str) -> float:
        """A string is as frequent as its rarest code point; the empty string beats all."""
        return min((self.counts.get(c, 0) for c in s), default=float("inf"))

    def representatives(self) -> dict[str, str]:
        groups: dict[str, list[str]] = {}
        for s in self.parent:
            groups.setdefault(self.find(s), []).append(s)
        best = {r: min(ms, key=lambda m: (-self.frequency(m), len(m) == 1 and len(_plain(m) or "") > 1, len(m), m)) for r, ms in groups.items()}
        return {s: best[self.find(s)] for s in self.parent}


def _plain(c: str) -> str | None:
    """What a full-width form or ligature decomposes into, if it shows the same."""
    tag, _, rest = unicodedata.decomposition(c).partition("> ")
    if not rest or tag[1:] in _SHOWN_APART:
        return None
    s = "".join(chr(int(x, 16)) for x in rest.split())
    wide = tag[1:] in ("wide", "narrow")
    return s if wide or all(x.isalpha() for x in s) else None


def build_rules(counts: dict[str, int]) -> dict[str, str]:
    """Rewrite rules (pattern -> representative) for a corpus with these counts of code points."""
    # a ligature never stands for its letters
    counts = {c: n for c, n in counts.items() if len(_plain(c) or "") < 2} | {c: 0 for c in counts if len(_plain(c) or "") > 1}
    looks = {a: b for one, other in LOOKS.items() for a, b in zip(one, other, strict=True)}
    alphabet = set(counts) | set(looks) | set(looks.values()) | {" "}
    singles = Classes(counts)
    for c in sorted(alphabet):
        if c in LAYOUT:
            continue
        if unicodedata.category(c) in INVISIBLE:
            singles.union(c, "")
        elif c.isspace():
            singles.union(c, " ")
        elif c in looks:
            singles.union(c, looks[c])
        if (plain := _plain(c)) is not None and not c.isspace():
            singles.union(c, "".join(x for x in plain))
    reps = singles.representatives()
    # Members of more than one code point are written by their own representatives.
    rules = {s: "".join(reps.get(c, c) for c in r) if len(r) > 1 else r for s, r in reps.items()}

    def shown(s: str) -> str:
        return "".join(rules.get(c, c) for c in s)

    # Composed letters meet the sequences of base and accents that show the same.
    composed = Classes({shown(c) or c: n for c, n in counts.items()} | counts)
    bases = {shown(c) for c in alphabet if c.isalpha()} - {""}
    marks = sorted(c for c in alphabet if unicodedata.combining(c))
    for c in sorted(alphabet):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and not c.isspace():
            composed.union(c, shown(parts))
            marks += [m for m in parts[1:] if m not in marks]
    for m in marks:
        for b in sorted(bases):
            one = unicodedata.normalize("NFC", b + m)
            if len(one) == 1 and len(b) == 1:
                composed.union(b + m, one)
    # The composed form stands for its class: it is the one that normal texts hold.
    for s, r in composed.representatives().items():
        r = unicodedata.normalize("NFC", r)
        if s != r:
            rules[s] = r
    return {s: r for s, r in rules.items() if s and s != r}


class Rewriter:
    """Greedy leftmost-longest rewriting by an Aho-Corasick automaton.

    Every pattern is one code point, or a letter with a combining accent.  A compiled character class
    finds the stretches of code points that patterns can end in, with the letter before; the automaton
    runs over those only."""

    def __init__(self, rules: dict[str, str]):
        self.rules = rules
        self.automaton = ahocorasick.Automaton()
        for s, r in rules.items():
            self.automaton.add_word(s, (len(s), r))
        self.ready = bool(rules)
        self.ascii_safe = all(not s.isascii() for s in rules)
        if self.ready:
            self.automaton.make_automaton()
            ends = "".join(sorted({re.escape(s[-1]) for s in rules}))
            self.stretch = re.compile(f".?[{ends}]+", re.S)

    def _rewritten(self, m: re.Match) -> str:
        text, parts, at = m[0], [], 0
        for end, (n, r) in self.automaton.iter_long(text):
            parts += (text[at : end + 1 - n], r)
            at = end + 1
        parts.append(text[at:])
        return "".join(parts)

    def __call__(self, text: str) -> str:
        if self.ascii_safe and text.isascii():
            return text
        text = unicodedata.normalize("NFC", text)
        for _ in range(len(text) + 2 if self.ready else 0):  # until stable: a letter with n accents needs n rounds
            new = self.stretch.sub(self._rewritten, text)
            if new == text:
                break
            text = unicodedata.normalize("NFC", new)
        return text


def count_code_points(texts: DataFrame, col: str = "text") -> dict[str, int]:
    """Counts of every code point over all texts.  Bounded by the size of Unicode, not by the data."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            joined = "".join(x for x in b.column(0).to_pylist() if x)
            n = np.bincount(np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32))
            for c in np.flatnonzero(n):
                total[int(c)] = total.get(int(c), 0) + int(n[c])
        yield pa.RecordBatch.from_pydict({"c": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    counted = texts.select(F.col(col).alias("text")).mapInArrow(per_batch, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    return {chr(r.c): r.n for r in counted.collect()}


def rules_for(texts: DataFrame, col: str = "text") -> dict[str, str]:
    return build_rules(count_code_points(texts, col))


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def canonical(texts: DataFrame, rules: dict[str, str], col: str = "text", out: str = "canonical") -> DataFrame:
    """``texts`` with the consistent form of ``col`` in the new column ``out`` (an existing column of
    that name is replaced)."""
    @pandas_udf("string")
    def rewrite(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = Rewriter(rules)
        for s in it:
            yield pd.Series([None if x is None else w(x) for x in s], dtype="object")

    return texts.withColumn(out, rewrite(F.col(col)))


def show_alike(texts: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Pairs (src, id_a, id_b) of rows of one source whose texts differ as stored but show the same.

    Rows are first reduced to 128-bit digests of both forms.  Pairs are made between *distinct* stored
    variants of a class and only then expanded to rows, so a third of all rows being copies of one
    text costs nothing but its own result.  Null and blank texts and rows without a key are left out."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Rewriter(rules)
        for b in batches:
            src, ids, raw, shown = [], [], [], []
            for s, i, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if t is None or not (c := w(t)).strip():
                    continue
                src.append(s), ids.append(i), raw.append(digest(t)), shown.append(digest(c))
            yield pa.RecordBatch.from_pydict({"src": src, "id": pa.array(ids, pa.int64()), "raw": pa.array(raw, pa.binary()), "shown": pa.array(shown, pa.binary())})

    rows = texts.select("src", "id", "text").where("id is not null").mapInArrow(digests, "src string, id bigint, raw binary, shown binary")
    rows = cut(rows)  # read twice more; the rewriting is the dear part
    variants = rows.groupBy("src", "shown", "raw").agg(F.lit(1).alias("one")).drop("one")
    classes = variants.groupBy("src", "shown").agg(F.count("*").alias("n")).where("n > 1")
    v = variants.join(classes.drop("n"), ["src", "shown"], "left_semi")
    pairs = v.alias("a").join(v.alias("b"), ["src", "shown"]).where("a.raw < b.raw").select("src", F.col("a.raw").alias("raw_a"), F.col("b.raw").alias("raw_b"), "shown")
    a = rows.select("src", "shown", F.col("raw").alias("raw_a"), F.col("id").alias("x"))
    b = rows.select("src", "shown", F.col("raw").alias("raw_b"), F.col("id").alias("y"))
    return (
        pairs.join(a, ["src", "shown", "raw_a"]).join(b, ["src", "shown", "raw_b"])
        .select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )


def usual_counts(alphabet: set[str]) -> dict[str, int]:
    """Counts that stand in for a corpus: the earlier a code point in Unicode, the more frequent."""
    return {c: 0x110000 - ord(c) for c in alphabet}


class LazyRewriter:
    """A rewriter without a pass over the corpus: rules are made for the code points as they turn up.

    Representatives follow ``usual_counts``, so every process makes the same ones.  For comparing
    texts; where the form itself is the result, take the corpus's own counts."""

    def __init__(self) -> None:
        self.alphabet = {chr(c) for c in range(128)} | {chr(c) for c in range(0xC0, 0x180)}
        self.inner = Rewriter(build_rules(usual_counts(self.alphabet)))

    def meet(self, texts: list[str]) -> None:
        new = set().union(*map(set, texts)) - self.alphabet if texts else set()
        if new:
            self.alphabet |= new | {c for x in new for c in unicodedata.normalize("NFD", x)}
            self.inner = Rewriter(build_rules(usual_counts(self.alphabet)))

    def __call__(self, text: str) -> str:
        return self.inner(text)
