"""Sentence boundaries across languages and scripts (problem 10): a hidden-event n-gram model.

Between any two words the event "a sentence ends here" is hidden.  Marks, blank lines, headings and list
items are what the event emits.  Counts over the whole corpus give an n-gram model of words with the
event as one more token, and what words stand before and behind marks:

- A blank line, a heading or a list item ends a sentence for certain; a mark with a lower-case word behind
  it ends none; what lies inside quotation marks or brackets is part of its sentence.
- Any other mark is weighed by the word before (an abbreviation is never seen at the end of a block, a
  word that ends sentences as often as any other is) and the word behind (is it seen at the start of
  blocks?).  Words outside the tables count by their shape.
- Where a block has marks, a gap without one holds no event for certain.  A block without any mark, in
  whatever script, is weighed at every gap by the n-gram model: P(end | before) P(behind | start) against
  (1 - P(end | before)) P(behind | before).

Forward-backward over all gaps of a block, with a price for very short sentences, gives posteriors; a
boundary is put where its posterior is above one half.  Behind a gap that is certain to hold no event the
chain starts anew, so such gaps are passed over: the posteriors of the others are the same.  Scripts
without spaces take each character as a word.  The ideographic full stop, the danda and the Arabic
question mark end a sentence wherever they stand outside quotations.

Counts are gathered over all texts.  The ``TYPES`` most frequent words before and behind marks, and the
n-grams in ``SLOTS`` hashed counters (less the median counter, which is what rare n-grams leave in each),
go to the tasks, so their size is fixed.

Defined cases: null, empty and blank texts have no sentences; closing quotation marks and brackets
belong to the sentence that they end; positions are code points of the text as stored; words of more
than ``LONGEST`` characters count as one word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tarnwell.llm.texts import slices

TYPES = 20_000
FLUSH = 200_000
#: hashed counters of single words, and of pairs with the event as a word
SLOTS = 1 << 18
PART = 1024
LONGEST = 64
#: a heading's most characters
HEADING = 100
#: words (characters, in scripts without spaces) of a block without marks that may hold more than one
#: sentence, and below which a sentence is very short
FEWEST, SHORT = {False: 8, True: 14}, {False: 3, True: 5}
#: log odds of an event at a gap in a block without marks, beside those of its words
UNMARKED = 0.0

_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_BULLET = re.compile(r"[^\S\n]*(?:([•‣◦▪●*–—-])|(\()?(\d{1,3}(?=[.)])|[a-zA-Z](?=\)))([.)])|(\d{1,3})(、))[^\S\n]+(?=\S)")
_HEADING = re.compile(r"[^\S\n]*(?:#{1,6}\s|\d{1,3}(?:\.\d{1,3})+\.?\s)\S")
_SPACE = re.compile(r"\s*")
#: marks that may end a sentence, and what quotes or brackets
_MARK = re.compile(r"[.!?…。！？｡．؟۔।॥]+|[«»„“”\"「」『』()\[\]（）]")
_SURE = set("。！？｡؟۔।॥")
_OPENS = {"«": "»", "„": "“", "“": "”", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "\"": "\""}
_CLOSERS = "\"'”’»“)]」』）"
_AFTER = re.compile(r"[\"'”’)\]」』）»]*")
_APART = frozenset(" \t\n\r\f\v\u00a0\u2028\u2029\u202f\u3000«»„“”\"「」『』()[]（）,;:")
_SOLID = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
#: a word, or a character of a script without spaces
_WORDS = re.compile(rf"[{_SOLID}]|[^\W_{_SOLID}]+(?:['’][^\W_{_SOLID}]+)*")
#: the same, with what ends sentences: a full stop behind letters and before a space and a capital, any
#: other mark, a blank line; a full stop elsewhere is doubtful
_EVENTS = re.compile(rf"[{_SOLID}]|[^\W_{_SOLID}]+(?:['’][^\W_{_SOLID}]+)*|(?<=[^\W\d_]{{3}})\.[\"'”’»)\]]*\s+(?=[\"'“„«(¿¡]*[^\W\da-zß-ÿа-я_])|[.!?…。！？｡؟۔।॥]|\n[^\S\n]*\n")
_ENDS = re.compile(r"[.!?…。！？｡．؟۔।॥]")
_GLUED = re.compile(r"^.*[^\W\d_]{3,}\.(?=[^\W\d_])")
_NEXT = re.compile(r"[\"'„“«¿¡(\[「『‘（]*(?:([^\W_]+)|(\S))")


def shape_before(w: str) -> str:
    """Shape of the word before a mark."""
    if not w:
        return "<none>"
    if w[-1].isdigit():
        return "<number>"
    last = re.split(r"[/²³]", w)[-1] or w
    if "/" in w:
        return "<unit>"
    if "." in w:
        return "<dotted>"
    if len(last) == 1:
        return "<initial>" if last.isupper() else "<letter>"
    if not last.isascii() and not last.lower() != last.upper():
        return "<uncased>"
    if len(last) <= 3:
        return "<Short>" if last[0].isupper() else "<short>"
    return "<Long>" if last[0].isupper() else "<long>"


def shape_behind(n: str) -> str:
    c = n[0]
    if c.isdigit():
        return "<number>"
    if c.isupper():
        return "<Upper>"
    if c.islower():
        return "<mixed>" if any(x.isupper() for x in n) else "<lower>"
    return "<uncased>"


def blocks(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _BLANK.finditer(text):
        if text[at : m.start()].strip():
            yield at, m.start()
        at = m.end()
    if text[at:].strip():
        yield at, len(text)


def _style(m: re.Match) -> tuple:
    return (m.group(1), m.group(2), m.group(4), m.group(6), bool(m.group(3) and m.group(3).isdigit()))


def _label(m: re.Match) -> int | None:
    n = m.group(3) or m.group(5)
    return int(n) if n and n.isdigit() else None


def units(text: str, a: int, b: int) -> list[tuple[int, int, bool]]:
    """A block's parts (start, stop, whole): a heading and each list item are whole, one sentence each;
    the rest is running text."""
    if "\n" not in text[a:b]:
        return [(a, b, bool(_HEADING.match(text, a, b) or _BULLET.match(text, a, b)))]
    starts = [a] + [m.end() for m in re.compile("\n").finditer(text, a, b) if m.end() < b]
    out: list[tuple[int, int, bool]] = []
    k = 0
    first_end = starts[1] if len(starts) > 1 else b
    line = text[a:first_end].strip()
    if _HEADING.match(text, a) and line[-1:] not in ".!?;,。" and len(line) < HEADING:
        behind = _SPACE.match(text, first_end).end()
        if text[behind : behind + 1].isupper() or _BULLET.match(text, first_end) or behind == len(text):
            out.append((a, first_end, True))
            k = 1
    if k >= len(starts):
        return out
    m = _BULLET.match(text, starts[k], b)
    if not m:
        # a list may begin under the line that announces it
        for j in range(k + 1, len(starts)):
            m = _BULLET.match(text, starts[j], b)
            before = text[: starts[j]].rstrip()[-1:]
            if m and before == ":" and (_label(m) in (1, None)):
                out.append((starts[k], starts[j], False))
                k = j
                break
        else:
            out.append((starts[k], b, False))
            return out
    style, label, item = _style(m), _label(m), starts[k]
    for s in starts[k + 1 :]:
        n = _BULLET.match(text, s, b)
        if n and _style(n) == style and (label is None or _label(n) == label + 1):
            out.append((item, s, True))
            item, label = s, _label(n)
    out.append((item, b, True))
    return out


def _trimmed(text: str, a: int, b: int) -> int:
    while b > a and text[b - 1].isspace():
        b -= 1
    return b


def _word_before(text: str, a: int, s: int) -> str:
    at = s
    while at > a and s - at <= LONGEST and text[at - 1] not in _APART:
        at -= 1
    if s - at > LONGEST:
        return "<long>"
    w = text[at:s].strip("\u200b\u200c\u200d\u2060\ufeff\xad'’‘")
    if "." in w:  # what stands before a full stop without space behind it is another sentence's
        w = _GLUED.sub("", w)
    return w


def marks(text: str, a: int, b: int) -> list[tuple[int, str, str | None, bool]]:
    """The marks of running text [a, b): (end, word before, word behind, sure).  The word behind is null
    at the end of the block.  Marks that cannot end a sentence are left out."""
    out: list[tuple[int, str, str | None, bool]] = []
    open_quotes: list[str] = []
    for m in _MARK.finditer(text, a, b):
        s, e = m.start(), m.end()
        c = text[s]
        if open_quotes and c == open_quotes[-1]:
            open_quotes.pop()
            # a quotation that ends with a mark may end the sentence it belongs to
            inner = text[max(a, s - 2) : s].rstrip()
            if open_quotes or not inner or inner[-1] not in ".!?…" or c in ")]）":
                continue
            end, word, sure = e, "<quoted>", False
        elif c in _OPENS:
            if c == "(" and s == a:
                continue
            open_quotes.append(_OPENS[c])
            continue
        elif c in "»”」』)]）":
            continue
        elif open_quotes and text.find(open_quotes[-1], e, b) >= 0:
            continue
        else:
            open_quotes.clear()
            end = _AFTER.match(text, e, b).end() if e < b and text[e] in _CLOSERS else e
            # a closing guillemet behind a space, as French sets it
            sure = c in _SURE
            if c == ".":
                word = _word_before(text, a, s) if e - s == 1 else "<dots>"
            else:
                word = "<mark>"
        at = end
        while at < b and text[at].isspace():
            at += 1
        if at >= b:
            continue  # the block's own end
        n = _NEXT.match(text, at, b)
        behind, other = n.group(1), n.group(2)
        if behind is None:
            if sure and at > end:
                out.append((end, word, "<other>", True))
            continue
        shape = shape_behind(behind)
        if shape == "<lower>" and not (sure and c in "。！？｡"):
            continue
        if at == end and not sure and word != "<quoted>":
            # no space: only between a word and a capital, or a mark and a new script run
            if shape == "<number>" and (not word[-1:].isalpha() or len(word) < 4):
                continue
            if c == "." and (shape == "<uncased>" or not (text[at] in "„“«¿¡\"" or len(behind) > 1 or len(word) > 3 and word[-1].islower())):
                continue
        elif at == end and sure and word == "<mark>" and c in "؟۔।॥" and shape == "<number>":
            continue
        out.append((end, word, behind, sure or word == "<mark>" and shape != "<number>"))
    return out


def _count(text: str, before: Counter, behind: Counter) -> None:
    """Count what stands before and behind the marks of one text, and at the ends of its blocks."""
    for a, b in blocks(text):
        for x, y, whole in units(text, a, b):
            if whole:
                continue
            n = _NEXT.match(text, _SPACE.match(text, x, y).end(), y)
            if n and n.group(1):
                behind[n.group(1), True] += 1
            for end, w, nxt, sure in marks(text, x, y):
                if sure or nxt is None:
                    continue
                before[w.lower(), shape_before(w) if w[:1] != "<" else w, False] += 1
                behind[nxt, False] += 1
            e = _trimmed(text, x, y)
            while e > x and text[e - 1] in _CLOSERS:
                e -= 1
            if e > x and text[e - 1] == "." and text[e - 2 : e - 1] != ".":
                w = _word_before(text, x, e - 1)
                before[w.lower(), shape_before(w) if w[:1] != "<" else w, True] += 1


class Ids(dict):
    """32-bit numbers of words, kept up to a bound; 1 is the event, 3 a doubtful mark."""

    def __init__(self) -> None:
        super().__init__(dict.fromkeys("!?…。！？｡؟۔।॥", 1))
        self["."] = 3

    def __missing__(self, w: str) -> int:
        if len(self) >= FLUSH:
            self.clear()
            self.__init__()
        h = self[w] = 1 if w[0] in ".\n" else (xxhash.xxh32_intdigest(w.lower()) | 2) + 2
        return h


def _pair_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(46)).astype(np.int64)


def _word_slots(a: np.ndarray) -> np.ndarray:
    return (a * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)


def _grams(texts: list[str], ids: Ids, single: np.ndarray, double: np.ndarray) -> None:
    """Count the words and pairs of texts, each of which begins and ends with the event."""
    flat = [1]
    for t in texts:
        flat += [ids[w] for w in _EVENTS.findall(t)]
        flat.append(1)
    x = np.array(flat, dtype=np.uint64)
    keep = np.append(True, (x[1:] != 1) | (x[:-1] != 1))  # events in a row are one
    x = x[keep]
    single += np.bincount(_word_slots(x), minlength=SLOTS)
    double += np.bincount(_pair_slots(x[:-1], x[1:]), minlength=SLOTS)


def learn(docs: DataFrame, text: str = "text", top: int = TYPES) -> dict:
    """The model's counts over all texts: at most ``top`` words before and ``top`` behind marks, shapes, and
    the n-grams' counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: Counter = Counter()
        behind: Counter = Counter()
        ids, single, double = Ids(), np.zeros(SLOTS, dtype=np.int64), np.zeros(SLOTS, dtype=np.int64)

        def batch(side: list, word: list, shape: list, edge: list, n: list, part: list, counters: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())
            cols = (side, word, shape, edge, n, part, counters)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["side", "word", "shape", "edge", "n", "part", "counters"])

        def passed() -> pa.RecordBatch:
            rows = [("w", w, s, f, n, None, None) for (w, s, f), n in before.items()] + [("n", w, shape_behind(w), f, n, None, None) for (w, f), n in behind.items()]
            return batch(*(list(zip(*rows, strict=True)) or [[]] * 7))

        for whole in batches:
            for b in slices(whole, [0]):
                texts = [t for t in b.column(0).to_pylist() if t]
                for t in texts:
                    _count(t, before, behind)
                _grams(texts, ids, single, double)
                if len(before) + len(behind) > FLUSH:
                    yield passed()
                    before.clear(), behind.clear()
        yield passed()
        both = np.concatenate([single, double]).reshape(-1, PART)
        some = np.flatnonzero(both.any(axis=1))
        m = len(some)
        yield batch(["c"] * m, [None] * m, [None] * m, [None] * m, [None] * m, some.tolist(), [both[k].tobytes() for k in some])

    def summed(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(c, dtype=np.int64) for c in t["counters"].to_pylist()], axis=0)
        return pa.table({"part": pa.array([t["part"][0].as_py()], pa.int32()), "counters": pa.array([total.tobytes()], pa.binary())})

    schema = "side string, word string, shape string, edge boolean, n bigint, part int, counters binary"
    counted = docs.select(text).mapInArrow(run, schema).persist()
    at, no = F.sum(F.when(F.col("edge"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("edge"), 0).otherwise(F.col("n")))
    words = counted.where("side <> 'c'").groupBy("side", "word", "shape").agg(at.alias("at"), no.alias("not_at")).persist()
    out: dict = {}
    for side in ("w", "n"):
        own = words.where(F.col("side") == side)
        shapes = own.groupBy("shape").agg(F.sum("at").alias("at"), F.sum("not_at").alias("not_at")).collect()
        most = own.orderBy(F.desc(F.col("at") + F.col("not_at")), "word").limit(top).collect()
        out[side] = {r.shape: (r["at"], r["not_at"]) for r in shapes} | {("", r.word): (r["at"], r["not_at"]) for r in most}
    both = np.zeros((2 * SLOTS // PART, PART), dtype=np.int64)
    for r in counted.where("side = 'c'").select("part", "counters").groupBy("part").applyInArrow(summed, "part int, counters binary").collect():  # 512 rows at most
        both[r.part] = np.frombuffer(r.counters, dtype=np.int64)
    words.unpersist()
    counted.unpersist()
    out["grams"] = both.reshape(2, SLOTS).astype(np.float32)
    return out


def _beta_binomial(k: int, n: int, mean: float, strength: float) -> float:
    """Log likelihood of k of n (without the binomial coefficient, which cancels)."""
    a, b = mean * strength, (1 - mean) * strength
    g = math.lgamma
    return g(k + a) + g(n - k + b) - g(n + a + b) - g(a) - g(b) + g(a + b)


class Model:
    """Log odds of a boundary between the word before a mark and the word behind it."""

    def __init__(self, counts: dict):
        self.w, self.n = counts["w"], counts["n"]
        longs = [self.w.get(s, (0, 0)) for s in ("<long>", "<Long>")]
        at, no = sum(x[0] for x in longs), sum(x[1] for x in longs)
        #: how often a word that ends a sentence ends its block
        self.rate = (at + 1) / (at + no + 4)
        self.starts = sum(v[0] for k, v in self.n.items() if isinstance(k, str)) + 1
        self.seen = sum(v[1] for k, v in self.n.items() if isinstance(k, str)) + 1
        self.odds_w: dict[str, float] = {}
        self.odds_n: dict[str, float] = {}
        # what rare words and pairs leave in each counter is the same everywhere
        self.single, self.double = (np.maximum(x - np.median(x), 0.0) for x in counts["grams"])
        self.words = max(1.0, float(self.single.sum()))
        self.events = max(1.0, float(self.single[_word_slots(np.array([1], dtype=np.uint64))[0]]))
        self.ids = Ids()

    def _ends(self, at: int, no: int) -> float:
        n = at + no
        return _beta_binomial(at, n, self.rate, 6.0) - _beta_binomial(at, n, 0.004, 60.0)

    def before(self, w: str) -> float:
        known = self.odds_w.get(w)
        if known is None:
            if len(self.odds_w) > FLUSH:
                self.odds_w.clear()
            shape = w if w[:1] == "<" else shape_before(w)
            if shape in ("<mark>", "<dots>", "<quoted>", "<none>"):
                known = 4.0
            else:
                prior = max(-3.0, min(3.0, self._ends(*self.w.get(shape, (0, 0)))))
                if shape in ("<long>", "<Long>", "<unit>", "<number>"):
                    prior = max(prior, 2.0)
                known = prior + self._ends(*self.w.get(("", w.lower()), (0, 0)))
            self.odds_w[w] = known = max(-12.0, min(12.0, known))
        return known

    def behind(self, n: str) -> float:
        known = self.odds_n.get(n)
        if known is None:
            if len(self.odds_n) > FLUSH:
                self.odds_n.clear()
            at, no = self.n.get(("", n), (0, 0))
            if at + no < 20:
                at, no = self.n.get(shape_behind(n), (0, 0))
            known = math.log((at + 0.5) / self.starts) - math.log((no + 0.5) / self.seen)
            self.odds_n[n] = known = max(-8.0, min(3.0, known))
        return known

    def odds(self, w: str, n: str) -> float:
        b, f = self.before(w), self.behind(n)
        # an abbreviation stays one before any word; a doubtful word yields to what is behind
        return b + f if b < 6 else b + max(f, -b - 1 if shape_before(w) == "<number>" and w[:1] != "<" else -5.0)


    def gaps(self, words: list[str]) -> np.ndarray:
        """Log odds of the event at each gap between words, by the n-gram model."""
        x = np.array([self.ids[w] for w in words], dtype=np.uint64)
        event = np.ones(1, dtype=np.uint64)
        a, b = x[:-1], x[1:]
        n = self.single[_word_slots(x)]
        mean = self.events / self.words
        # priors: of an end that of all words, of a word behind that of any word
        end = (np.minimum(self.double[_pair_slots(a, event)], n[:-1]) + 20 * mean) / (n[:-1] + 20)
        any_ = (n[1:] + 0.5) / (self.words + 1)
        start = (np.minimum(self.double[_pair_slots(event, b)], n[1:]) + 20 * any_) / (self.events + 20)
        behind = (np.minimum(self.double[_pair_slots(a, b)], np.minimum(n[:-1], n[1:])) + 5 * any_) / (n[:-1] + 5)
        return np.log(end) + np.log(start) - np.log1p(-np.minimum(end, 0.999)) - np.log(behind)


def _unmarked(text: str, a: int, b: int, model: Model) -> list[int]:
    """The ends of sentences inside running text [a, b) that holds no mark at all."""
    found = list(_WORDS.finditer(text, a, b))
    solid = len(found) > 1 and sum(len(m[0]) == 1 and m[0] > "\u3000" for m in found) > len(found) / 2
    if len(found) < FEWEST[solid]:
        return []
    odds = model.gaps([m[0] for m in found]) + UNMARKED
    for k, (m, n) in enumerate(zip(found, found[1:], strict=False)):
        between = text[m.end() : n.start()]
        if between.strip() or not between and not solid:  # inside a word, or a comma and the like
            odds[k] = -50.0
    near = [True] * len(odds)
    return [found[k].end() for k, p in enumerate(posteriors(odds.tolist(), near, SHORT[solid], True)) if p > 0.5]


def posteriors(odds: list[float], near: list[bool], reach: int = 1, edges: bool = False) -> list[float]:
    """Forward-backward over gaps in order.  The state counts the gaps since the last boundary, up to
    ``reach``; a boundary within reach of another is unlikely, where ``near[k]`` says that gap k lies close
    behind gap k - 1.  With ``edges`` the block's own ends are boundaries too."""
    short = math.exp(-2.0 if reach == 1 else -4.0)
    m = reach + 1  # state j: j gaps behind a boundary, the last one: farther

    def price(k: int, j: int) -> float:
        return short if near[k] and j < reach else 1.0

    p = [1 / (1 + math.exp(-max(-60.0, min(60.0, o)))) for o in odds]
    f: list[list[float]] = []
    v = [0.0] * m
    v[0 if edges else reach] = 1.0
    for k in range(len(odds)):
        new = [sum(x * price(k, j) for j, x in enumerate(v)) * p[k]] + [0.0] * reach
        for j, x in enumerate(v):
            new[min(j + 1, reach)] += x * (1 - p[k])
        z = sum(new) or 1.0
        v = [x / z for x in new]
        f.append(v)
    out = [0.0] * len(odds)
    g = [short if edges and j < reach else 1.0 for j in range(m)]
    for k in range(len(odds) - 1, -1, -1):
        both = [x * y for x, y in zip(f[k], g, strict=True)]
        out[k] = both[0] / (sum(both) or 1.0)
        g = [p[k] * price(k, j) * g[0] + (1 - p[k]) * g[min(j + 1, reach)] for j in range(m)]
        z = sum(g) or 1.0
        g = [x / z for x in g]
    return out


def ends(text: str, model: Model) -> list[int]:
    """The ends of the sentences of a text, in order."""
    out: list[int] = []
    for a, b in blocks(text):
        for x, y, whole in units(text, a, b):
            if not whole:
                found = marks(text, x, y)
                if found:
                    odds = [10.0 if sure else model.odds(w, n) for _, w, n, sure in found]
                    near = [False] + [len(text[p[0] : q[0]].split()) < 2 for p, q in zip(found, found[1:], strict=False)]
                    # marks that no pair of which is close don't bear on one another
                    likely = posteriors(odds, near) if any(near) else [0.5 + o for o in odds]
                    out += [m[0] for m, p in zip(found, likely, strict=True) if p > 0.5]
                elif not _ENDS.search(text, x, y):
                    out += _unmarked(text, x, y, model)
            end = _trimmed(text, x, y)
            if end > x and (not out or out[-1] < end):
                out.append(end)
    return out


def split(docs: DataFrame, counts: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence_no, start_pos, end_pos): the sentences of every text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(counts)
        for whole in batches:
            for b in slices(whole, [1]):
                ids, no, start, stop = [], [], [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if not t:
                        continue
                    at = 0
                    for n, e in enumerate(ends(t, model)):
                        while t[at].isspace():
                            at += 1
                        ids.append(i), no.append(n), start.append(at), stop.append(e)
                        at = e
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, b.column(0).type), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())],
                    names=[key, "sentence_no", "start_pos", "end_pos"],
                )

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, sentence_no int, start_pos bigint, end_pos bigint")
