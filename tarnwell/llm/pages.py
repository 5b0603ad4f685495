"""Repair of text from scanned pages (problem 7): running lines, cut words, misread characters.

Every line of a page is first classed as running text or *furniture* (headers, footers, page numbers).
Furniture recurs: a line's form - numbers, the document's title and publishers' names masked - that
stands at the edges of pages of several documents, and hardly ever inside pages, is furniture wherever
it stands (``forms``).  A line of digits only, which tables hold too, is classed by its place.  What remains is a stream of characters without line ends, over which words are decoded
jointly by dynamic programming: from any place that a word may start, a word may end at the token's end,
inside it (words run together), behind a cut with or without its hyphen, or behind a blank (a torn
word), read as it stands or with a confusion of characters undone.  A word costs the negative logarithm
of its frequency, and each operation its price.  Stretches in which every word is known and no line end
is marked have one reading and are passed over, so decoding is local and cheap.
Paragraphs are then chosen by dynamic programming over
the lines, from blank lines, line lengths, final marks and initial letters.

The lexicon holds the ``LEXICON`` most frequent words and compounds of the whole corpus with their
counts; its size is fixed, so it can be sent to every task.  Words beyond it are names and the like;
they are never taken for misread.  What scanners confuse is learnt from it: characters of frequent words
that are replaced by the same others in many rare words (``confusions``).  All thresholds are shares of
the corpus, so a corpus of twice as many copies is read alike.

Defined cases: null texts give null, empty and blank ones an empty text and no notes; look-alike and
invisible characters are no noise here (problem 2 treats them); a cut may go on behind furniture and
blank lines; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tarnwell.llm.lookalike import LazyRewriter
from tarnwell.llm.texts import slices

LEXICON = 30_000
#: a misread word must be this many times rarer than what it is read as
RATIO = 8
#: entries of a partial count before it is passed on
FLUSH = 300_000
CACHE = 200_000
# Prices of the decoder, in nats beside the negative log frequencies.
CONFUSED, UNKNOWN, HYPHEN, KEPT, MERGED, SPLIT = math.log(RATIO), 12.0, 1.0, 8.0, 3.0, 5.0
# Shares of all words: of a word that others may be read as, of one that words with more than one
# confusion may be read as, of both words of a run-together pair, and of words that confusions are
# learnt from.
READ, FAR, COMMON, FREQUENT = 2.75e-6, 1.1e-5, 1 / 5_800, 2e-5
#: a confusion shows in this share of the frequent words that it could show in, and in so many of them
COVERED, SHOWN = 0.2, 5
#: characters of a word at most
WIDE = 40
#: a form of furniture stands on this share of all pages and in so many documents, and this share of its
#: lines is among the first or last EDGE lines of a page
PAGES, DOCUMENTS, OUTSIDE, EDGE = 0.01, 2, 0.8, 2
#: characters of a line whose form is counted, at most
LINE = 200

#: marks that a cut word may end with
MARKS = "-‐\xad¬"

_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
#: a mark at a line end with what follows it; the words on either side are parts of words
_CUT = re.compile(rf"[{MARKS}]\s*\n\s*\S+")
_WHOLE = re.compile(r"[^\W_]++(?:-[^\W_]++)*+(?!\0)")
_UNSEEN = dict.fromkeys(map(ord, "​‌‍⁠﻿"))

_NUMBER = re.compile(r"\d{1,4}")
_ROW = re.compile(r".*\|.*")
_CAPTION = re.compile(r"(?:table|figure)\s+\d+", re.I)


_DIGITS = re.compile(r"\d+")
_DIGIT = re.compile(r"\d")


class Forms:
    """Forms of lines, and those that are furniture: ``furniture`` are masked lines, ``endings`` the words
    that titles end with."""

    def __init__(self, names: frozenset[str], furniture: frozenset[str] = frozenset(), endings: frozenset[str] = frozenset()):
        self.listed, self.known, self.endings = names, furniture, endings
        self.automaton = ahocorasick.Automaton()
        for n in names:
            self.automaton.add_word(n, len(n))
        if names:
            self.automaton.make_automaton()
        #: a line whose numbers are masked is too long for any form if it is longer than this
        self.longest = max(map(len, furniture), default=0) + max(map(len, names), default=0)
        # A row may lack its title or have another: what looks like a title stands for it, too.
        title = rf"[^.;!?|]+: [^.;!?|]+ (?:{'|'.join(sorted(map(re.escape, endings)))})" if endings else r"(?!)"
        open_ = [re.escape(f).replace("\\~t", "~t").replace("\\~s", "~s").replace("~t", title).replace("~s", r"[^.;!?:|]+") for f in sorted(furniture) if "~t" in f or "~s" in f]
        self.untitled = re.compile("|".join(open_)) if open_ else None

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Where names stand as whole words, the longest at each place, from the left."""
        if not self.listed:
            return
        some: dict[int, int] = {}
        for last, n in self.automaton.iter(text):
            a, b = last + 1 - n, last + 1
            if not (a and (text[a - 1].isalnum() or text[a - 1] == "_")) and not (b < len(text) and (text[b].isalnum() or text[b] == "_")):
                some[a] = max(b, some.get(a, 0))
        at = 0
        for a in sorted(some):
            if a >= at:
                yield a, some[a]
                at = some[a]

    def named(self, text: str) -> bool:
        return next(self.spans(text), None) is not None

    def form(self, line: str, title: tuple[str, str] | None) -> str:
        """The masked form of a casefolded line."""
        if title is not None:
            line = line.replace(title[0], "~t")
            if len(title[1]) > 5:
                line = line.replace(title[1], "~s")
        out, at = [], 0
        for a, b in self.spans(line):
            out.append(line[at:a])
            at = b
        return _DIGITS.sub("#", "~p".join([*out, line[at:]]) if at else line)

    def variable(self, line: str, title: tuple[str, str] | None, named: bool) -> bool:
        """Whether a line holds anything that its form masks."""
        return bool(_DIGIT.search(line)) or title is not None and title[1] in line or named and self.named(line)

    def is_furniture(self, line: str, title: tuple[str, str] | None, named: bool) -> bool:
        if line in self.known:
            return True
        digit, own = bool(_DIGIT.search(line)), title is not None and title[1] in line
        if (own or digit or named and self.named(line)) and (own or len(line) <= self.longest or len(_DIGITS.sub("#", line)) <= self.longest) and self.form(line, title) in self.known:
            return True
        if self.untitled is None or not any(e in line for e in self.endings) and not (digit and self.named(line)):
            return False
        return self.untitled.fullmatch(self.form(line, None)) is not None


def titled(title: str | None) -> tuple[str, str] | None:
    """A title and what stands before its colon, casefolded."""
    t = title.strip().casefold() if title else ""
    return (t, t.split(":")[0]) if t else None


def furniture(lines: list[str], forms: Forms, title: str | None, page: int | None) -> set[int]:
    """Numbers (from 0) of the furniture lines of one page; ``lines`` in consistent form, stripped."""
    shown = [k for k, s in enumerate(lines) if s]
    if not shown:
        return set()
    heading = titled(title)
    named = forms.named("\n".join(lines).casefold())
    out = {k for k in shown if not _NUMBER.fullmatch(lines[k]) and forms.is_furniture(lines[k].casefold(), heading, named)}
    for at, k in enumerate(shown):
        if _NUMBER.fullmatch(lines[k]) and _lone_number(lines, shown, at, out, page):
            out.add(k)
    return out


def _tabular(s: str) -> bool:
    return bool(_ROW.fullmatch(s) or _CAPTION.match(s) or _NUMBER.fullmatch(s))


def _lone_number(lines: list[str], shown: list[int], at: int, out: set[int], page: int | None) -> bool:
    """A line of digits only: a page number at the edge of a page or inside running text, a cell inside a
    table."""
    k = shown[at]
    before = next((j for j in reversed(shown[:at]) if j not in out), None)
    after = next((j for j in shown[at + 1 :] if j not in out), None)
    if after is None:
        if before is None or not _tabular(lines[before]):
            return True
        return k - before > 1 or page is not None and lines[k] == str(page)
    if before is None:
        return not _tabular(lines[after])
    return not _tabular(lines[before]) and not _tabular(lines[after])


def confusions(counts: dict[str, int]) -> list[tuple[str, str]]:
    """What is taken for what, as (written, seen): strings of one or two characters such that many frequent
    words that hold the one are also met, far more rarely, with the other in its place."""
    total = sum(counts.values())
    words = [w for w in counts if len(w) > 3 and "-" not in w]
    frequent = [w for w in words if counts[w] >= FREQUENT * total and w.isalpha()]

    def gaps(w: str) -> Iterator[tuple[tuple[str, str], str]]:
        for n in (1, 2):
            for k in range(len(w) - n + 1):
                yield (w[:k], w[k + n :]), w[k : k + n]

    same: dict[tuple[str, str], list[tuple[str, int]]] = {rest: [] for w in frequent for rest, _ in gaps(w)}
    for w in words:
        for rest, y in gaps(w):
            if rest in same:
                same[rest].append((y, counts[w]))
    shown: Counter[tuple[str, str]] = Counter()
    could: Counter[str] = Counter()
    for w in frequent:
        for rest, x in gaps(w):
            could[x] += 1
            for y, m in same[rest]:
                if x[0] != y[0] and x[-1] != y[-1] and len(x) + len(y) < 4 and m * RATIO <= counts[w]:
                    shown[x, y] += 1
    found = {(x, y) for (x, y), n in shown.items() if n >= SHOWN and n >= COVERED * could[x]}
    return sorted(found | {(y, x) for x, y in found})


class Lexicon:
    """Counts of the most frequent words, and readings of words by them."""

    def __init__(self, counts: dict[str, int], confused: list[tuple[str, str]] | None = None):
        self.counts = counts
        self.total = max(1, sum(counts.values()))
        self.known: dict[str, str | None] = {}
        self.lone: dict[str, bool] = {}
        #: tokens that stand for themselves wherever they stand
        self.sure: set[str] = set()
        self.decoded: dict[tuple, list] = {}
        confused = confusions(counts) if confused is None else confused
        self.undo: dict[str, list[tuple[str, str]]] = {}
        for x, y in confused:
            self.undo.setdefault(y[0], []).append((y, x))
        # characters that are taken for one another, in classes, and pairs as the class of what they are taken for
        head: dict[str, str] = {}

        def root(c: str) -> str:
            while head.get(c, c) != c:
                c = head[c]
            return c

        for x, y in confused:
            if len(x) == len(y) == 1:
                head[max(root(x), root(y))] = min(root(x), root(y))
        self.single = str.maketrans({c: root(c) for c in head})
        self.pairs = {max(p, key=len): root(min(p, key=len)) for p in confused if len(p[0]) != len(p[1])}
        self.paired = re.compile("|".join(sorted(map(re.escape, self.pairs)))) if self.pairs else None
        #: the most frequent word of each skeleton
        self.skeletons: dict[str, str] = {}
        for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if n <= FAR * self.total:
                break
            if len(w) > 5 and w.isalpha():
                self.skeletons.setdefault(self.skeleton(w), w)

    def skeleton(self, w: str) -> str:
        """What all readings of a word by confusions have in common, in most cases."""
        return (self.paired.sub(lambda m: self.pairs[m[0]], w) if self.paired else w).translate(self.single)

    def share(self, word: str) -> float:
        return self.counts.get(word, 0) / self.total

    def readings(self, w: str) -> Iterator[str]:
        for k, c in enumerate(w):
            for seen, written in self.undo.get(c, ()):
                if w.startswith(seen, k):
                    yield w[:k] + written + w[k + len(seen) :]

    def reading(self, word: str) -> str | None:
        """What a word is misread from, null if it stands for itself."""
        w = word.lower()
        if w in self.known:
            return self.known[w]
        if len(self.known) > CACHE:
            self.known.clear()
        self.known[w] = out = self._reading(w)
        return out

    def _reading(self, w: str) -> str | None:
        own = self.counts.get(w, 0)
        digits = any(c.isdigit() for c in w)
        if len(w) < 3 or w.isdigit() or (digits and not any(c.isalpha() for c in w)):
            return None
        best, most = None, max(RATIO * own, READ * self.total)
        for v in self.readings(w):
            n = self.counts.get(v, 0)
            if n > most and len(v) > 2 and v.isalpha():
                best, most = v, n
        if best is None and own == 0 and len(w) > 5:
            # more than one confusion: words of one skeleton
            v = self.skeletons.get(self.skeleton(w))
            if v is not None and v != w:
                best = v
        return best

    def price(self, word: str) -> float:
        """Negative log frequency; a word that the lexicon lacks pays by its length, a compound that it
        lacks pays for its parts."""
        n = self.counts.get(word)
        if n:
            return math.log(self.total / n)
        if "-" in word:
            return sum(map(self.price, word.split("-"))) + HYPHEN
        return UNKNOWN + 0.4 * len(word)

    def decode(self, units: list[tuple[str, str]]) -> list[tuple[int, int, int, str, str]]:
        """The cheapest reading of a stretch, given as tokens each with what parts it from the next: a mark at
        a line end, or a blank for any other white space.  Gives (unit, place in it, next unit, operation,
        word) steps; operations are ``keep``, ``read`` (confusions undone), ``join`` (over a cut),
        ``compound`` (the mark belongs), ``merge`` (a word torn by a blank) and ``piece`` (of words run together)."""
        key = tuple(units)
        known = self.decoded.get(key)
        if known is None:
            if len(self.decoded) > CACHE // 4:
                self.decoded.clear()
            known = self.decoded[key] = self._decode(units)
        return known

    def _decode(self, units: list[tuple[str, str]]) -> list[tuple[int, int, int, str, str]]:
        start, n = [], 0
        for t, _ in units:
            start.append(n)
            n += len(t)
        home = [u for u, (t, _) in enumerate(units) for _ in t]
        best: list[tuple[float, int, str, str]] = [(0.0, 0, "", "")] + [(math.inf, 0, "", "")] * n
        for i in range(n):
            so_far = best[i][0]
            if so_far == math.inf:
                continue
            u = home[i]
            for far, price, operation, word in self._steps(units, u, i - start[u]):
                if so_far + price < best[i + far][0]:
                    best[i + far] = (so_far + price, i, operation, word)
        out, at = [], n
        while at:
            _, i, operation, word = best[at]
            out.append((home[i], i - start[home[i]], home[at] if at < n else len(units), operation, word))
            at = i
        return out[::-1]

    def _steps(self, units: list[tuple[str, str]], u: int, at: int) -> Iterator[tuple[int, float, str, str]]:
        """Words that start at a place of a token: (characters, price, operation, word)."""
        token, sep = units[u]
        rest = token[at:]
        w = rest.lower()
        last = u + 1 == len(units)
        cut = not last and sep != "" and sep in MARKS
        if not cut:
            if at == 0:
                yield len(rest), self.price(w), "keep", token
                fixed = self._fixed(token)
                if fixed is not None:
                    yield len(rest), self.price(fixed) + CONFUSED, "read", fixed
            else:
                for v, more in ((w, 0.0), (self.reading(w) or "", CONFUSED)):
                    if self.share(v) > COMMON:
                        yield len(rest), self.price(v) + more, "piece", v
        if w not in self.counts and w == rest and w.isalpha():
            if not cut and not last and units[u + 1][0] not in self.counts:
                whole = w + units[u + 1][0]
                if units[u + 1][1] not in MARKS or u + 2 == len(units):
                    for v, more in ((whole, 0.0), (self.reading(whole) or "", CONFUSED)):
                        if self.share(v) > READ:
                            yield len(whole), self.price(v) + MERGED + more, "merge", v
            if 7 < len(w) <= WIDE:
                for k in range(4, len(w) - 3):
                    for v, more in ((w[:k], 0.0), (self.reading(w[:k]) or "", CONFUSED)):
                        if self.share(v) > COMMON:
                            yield k, self.price(v) + SPLIT + more, "piece", v
        if cut:
            yield from self._over_cut(rest, sep, units[u + 1][0])

    def _over_cut(self, left: str, mark: str, right: str) -> Iterator[tuple[int, float, str, str]]:
        """Both readings of a cut: one word, or a compound whose hyphen happens to end the line."""
        far = len(left) + len(right)
        compound = f"{left}-{right}"
        kept = 0.0 if mark == "-" else KEPT
        yield far, self.price(compound.lower()) + kept, "compound", compound
        if left[-1].isdigit() or not right[0].isalpha():
            return
        if right[0].isupper() and not (left.isupper() and right.isupper()):
            return
        whole = left + right
        yield far, self.price(whole.lower()), "join", whole
        fixed = self._fixed(whole)
        if fixed is not None:
            yield far, self.price(fixed) + CONFUSED, "join", fixed

    def alone(self, w: str) -> bool:
        """Whether an unknown word has no other reading by itself."""
        known = self.lone.get(w)
        if known is None:
            if len(self.lone) > CACHE:
                self.lone.clear()
            known = self.lone[w] = sum(1 for _ in self._steps([(w, " ")], 0, 0)) == 1
        return known

    def _fixed(self, token: str) -> str | None:
        """A token with its misread parts put right, null if none is."""
        parts = [self.reading(p) or p.lower() for p in token.split("-")]
        fixed = "-".join(parts)
        return fixed if fixed != token.lower() else None


def _ends(line: str) -> tuple[str, str] | None:
    """(last word without its mark, mark) of a line that ends with a mark."""
    s = line.rstrip()
    if not s or s[-1].isalnum() or s[-1] in ".,;:":
        return None
    s = s.translate(_UNSEEN)
    if len(s) < 2 or s[-1] not in MARKS or not s[-2].isalnum():
        return None
    return re.search(r"[^\s]*$", s[:-1].replace("\xad", ""))[0], s[-1]


_FIRST = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


class Page:
    """One text of a page: its notes and its repaired form."""

    def __init__(self, text: str, lexicon: Lexicon, form: LazyRewriter, forms: Forms, title: str | None, page: int | None):
        self.raw = text.split("\n")
        self.lexicon = lexicon
        whole = form(text.replace("\xad\n", "-\n"))
        self.lines = [s.strip() for s in whole.split("\n")]
        if len(self.lines) != len(self.raw):
            self.lines = [form(s).strip() for s in self.raw]
        self.out = furniture(self.lines, forms, title, page)
        self.running = [k for k, s in enumerate(self.lines) if s and k not in self.out]
        #: line -> (the line that goes on, the whole word, its left part, its right part)
        self.breaks: dict[int, tuple[int, str, str, str]] = {}
        self.misread: set[int] = set()
        self._decode()

    def _decode(self) -> None:
        """Cut the stream of running text into stretches of uncertain tokens, and decode each."""
        counts, reading, sure = self.lexicon.counts, self.lexicon.reading, self.lexicon.sure
        self.fixes: dict[int, dict[str, str]] = {}
        stretch: list[tuple[str, str]] = []
        place: list[int] = []

        def close() -> None:
            if stretch:
                self._apply(stretch, place)
                stretch.clear(), place.clear()

        carried: tuple[str, str] | None = None  # the left part of a cut, and its mark
        for k, nxt in zip(self.running, [*self.running[1:], None], strict=False):
            line = self.lines[k]
            tokens = _TOKEN.findall(line)
            if carried is not None:
                stretch.append(carried), place.append(before)
                stretch.append((tokens[0], " ")), place.append(k)
                tokens = tokens[1:]
                carried = None
            end = _ends(self.raw[k]) if nxt is not None else None
            if end is not None and tokens and _FIRST.match(self.lines[nxt]) and line.rstrip(MARKS + " ").endswith(tokens[-1]):
                carried, before = (tokens.pop(), end[1]), k
            for at, t in enumerate(tokens):
                if t in sure:
                    if stretch:
                        close()
                    continue
                n = counts.get(t)
                if n is None and t.islower() and t.isalpha():  # a name, unless it can be merged or split
                    certain = self.lexicon.alone(t) and not (at + 1 < len(tokens) and t + tokens[at + 1] in counts)
                elif "-" in t:
                    certain = all(reading(p) is None for p in t.split("-"))
                else:
                    certain = reading(t) is None and (n is not None or not t.islower() or len(t) < 3)
                if certain:
                    if n is not None or not (t.islower() and t.isalpha()):  # whatever stands beside it
                        if len(sure) > CACHE:
                            sure.clear()
                        sure.add(t)
                    if stretch:
                        close()
                else:
                    stretch.append((t, " ")), place.append(k)
            if carried is None and stretch and nxt is None:
                close()
        close()

    def _apply(self, stretch: list[tuple[str, str]], place: list[int]) -> None:
        pieces: dict[int, list[str]] = {}
        for i, at, _, operation, word in self.lexicon.decode(stretch):
            k, token = place[i], stretch[i][0][at:]
            if operation == "read":
                self.misread.add(k)
                self.fixes.setdefault(k, {})[token] = word
            elif operation == "piece":
                pieces.setdefault(i, []).append(word)
            elif operation == "merge":
                self.fixes.setdefault(k, {})[f"{token} {stretch[i + 1][0]}"] = word
            elif operation == "join":
                right = stretch[i + 1][0]
                self.breaks[k] = (place[i + 1], f" {word}" if at else word, token, right)
                plain = (token + right).lower()
                if word.lower() != plain:  # which side of the cut holds the wrong characters
                    same = next((x for x, (p, q) in enumerate(zip(plain, word.lower(), strict=False)) if p != q), len(plain) - 1)
                    self.misread.add(k if same < len(token) else place[i + 1])
            elif operation == "compound":
                for side in (i, i + 1):
                    fixed = self.lexicon._fixed(stretch[side][0])
                    if fixed is not None:
                        self.misread.add(place[side])
                        self.fixes.setdefault(place[side], {})[stretch[side][0]] = fixed
        for i, words in pieces.items():
            whole = stretch[i][0]
            if sum(map(len, words)) >= len(whole) - 2:  # a piece that goes on over a cut is joined there
                self.fixes.setdefault(place[i], {})[whole] = " ".join(words)

    def notes(self) -> list[tuple[int, str]]:
        return sorted([(k + 1, "break") for k in self.breaks] + [(k + 1, "furniture") for k in self.out] + [(k + 1, "misread") for k in self.misread])

    def repaired(self) -> str:
        """Continuous paragraphs, parted by blank lines."""
        paragraphs: list[list[str]] = []
        starts = self._paragraphs()
        drop_first: dict[int, str] = {}
        for at, k in enumerate(self.running):
            s = self.lines[k]
            for wrong, right in self.fixes.get(k, {}).items():
                s = re.sub(rf"(?<![^\W_]){re.escape(wrong)}(?![^\W_])", right.capitalize() if wrong[:1].isupper() else right, s)
            if k in drop_first:
                s = s[len(drop_first[k]) :].lstrip() if s.startswith(drop_first[k]) else s
            if k in self.breaks:
                nxt, word, left, right = self.breaks[k]
                rest = self.lines[nxt].split(None, 1)[0]
                s = s.rstrip(MARKS + " ")
                s = s[: len(s) - len(left)] + (word.capitalize() if left[:1].isupper() and word.islower() else word) + rest[len(right) :]
                drop_first[nxt] = rest
            if at in starts or not paragraphs:
                paragraphs.append([])
            if s:
                paragraphs[-1].append(s)
        joined = []
        for p in paragraphs:
            text = ""
            for s in p:
                text += s if not text or text.endswith("-") and text[-2:-1].isalnum() else " " + s
            joined.append(text)
        return "\n\n".join(x for x in joined if x)

    def _paragraphs(self) -> set[int]:
        """Places in ``running`` that start a paragraph: least cost over all labelings of the line ends,
        where a paragraph of one short line costs extra unless it is a heading or a table row."""
        r = self.running
        if not r:
            return set()
        lengths = sorted(len(self.lines[k]) for k in r)
        width = lengths[int(0.8 * (len(lengths) - 1))]
        stay, start = [0.0], [0.0]
        back: list[tuple[int, int]] = [(0, 0)]
        for a, b in zip(r, r[1:], strict=False):
            s, t = self.lines[a], self.lines[b]
            gap = any(not self.lines[j] for j in range(a + 1, b))
            cost_new = cost_old = 0.0
            cost_old += 4.0 * gap + 1.5 * (len(s) < 0.6 * width) + 5.0 * (_tabular(s) or _tabular(t)) + 1.0 * (t[:1].isupper() and s[-1:] in ".!?:")
            cost_new += 3.0 * (not gap) + 6.0 * (a in self.breaks) + 2.0 * t[:1].islower() + 1.5 * (s[-1:] not in ".!?:" and len(s) > 0.8 * width)
            old, new = min((stay[-1], 0), (start[-1], 1)), min((stay[-1], 0), (start[-1] + 0.5 * (not _tabular(s)), 1))
            stay.append(old[0] + cost_old), start.append(new[0] + cost_new)
            back.append((old[1], new[1]))
        state = 0 if stay[-1] <= start[-1] else 1
        out = {0}
        for at in range(len(r) - 1, 0, -1):
            if state:
                out.add(at)
            state = back[at][state]
        return out


def _line_forms(texts: list[str], forms: Forms, title: tuple[str, str] | None) -> tuple[set[str], set[str]]:
    """Forms of the lines at the edges of a page's texts, and of those inside that mask something."""
    edge, inside = set(), set()
    for t in texts:
        t = t.casefold()
        lines = [s for s in map(str.strip, t.split("\n")) if s]
        named = forms.named(t)
        for k, s in enumerate(lines):
            if len(s) > LINE:
                continue
            if k < EDGE or k >= len(lines) - EDGE:
                edge.add(forms.form(s, title))
            elif forms.variable(s, title, named):
                inside.add(forms.form(s, title))
    return edge, inside


def learn(texts: DataFrame, columns: list[str], names: frozenset[str], top: int = LEXICON) -> tuple[dict[str, int], Forms]:
    """From all texts of (document_id, title, *columns): the ``top`` most frequent words and compounds with
    their counts, cut words left out, and the forms of furniture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, forms = LazyRewriter(), Forms(names)
        total: Counter[tuple[str, str]] = Counter()
        words: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            rows = [("w", w, "", n) for w, n in words.items()] + [(k[0], k[1:], d, n) for (k, d), n in total.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            words.clear(), total.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["kind", "w", "d", "n"])

        for whole in batches:
            for b in slices(whole, list(range(2, whole.num_columns)), 500):
                rows = [b.column(j).to_pylist() for j in range(b.num_columns)]
                # a field that repeats another of its row says nothing new
                kept = [[t for t in dict.fromkeys(row) if t] for row in zip(*rows[2:], strict=True)]
                form.meet([t for row in kept for t in row])
                for doc, title, row in zip(rows[0], rows[1], kept, strict=True):
                    same = [form(t.replace("\xad\n", "-\n")) for t in row]
                    for t in same:
                        words.update(_WHOLE.findall(_CUT.sub("\0", t).lower()))
                    heading = titled(title)
                    edge, inside = _line_forms(same, forms, heading)
                    d = xxhash.xxh32_hexdigest(doc or "")
                    total.update(("e" + k, d) for k in edge)
                    total.update(("i" + xxhash.xxh3_64_hexdigest(k), "") for k in inside)
                    if row:
                        total["p", ""] += 1
                    if heading is not None:
                        total["t" + heading[0].rsplit(None, 1)[-1], ""] += 1
                if len(total) + len(words) > FLUSH:
                    yield passed()
        yield passed()

    counted = texts.select("document_id", "title", *columns).mapInArrow(run, "kind string, w string, d string, n bigint")
    counted = counted.groupBy("kind", "w", "d").agg(F.sum("n").alias("n")).groupBy("kind", "w").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).persist()
    words = {r.w: r.n for r in counted.where("kind = 'w'").orderBy(F.desc("n"), "w").limit(top).collect()}
    pages = counted.where("kind = 'p'").agg(F.sum("n")).first()[0] or 0
    # a page has few edge lines, so few forms can stand on that share of all pages
    often = {r.w: r.n for r in counted.where((F.col("kind") == "e") & (F.col("n") >= PAGES * pages) & (F.col("docs") >= DOCUMENTS)).select("w", "n").collect()}
    hashes = {xxhash.xxh3_64_hexdigest(w): w for w in often}
    inside = {hashes[r.w]: r.n for r in counted.where((F.col("kind") == "i") & F.col("w").isin(*hashes)).collect()} if hashes else {}
    titles = counted.where("kind = 't'").agg(F.sum("n")).first()[0] or 0
    endings = [r.w for r in counted.where((F.col("kind") == "t") & (F.col("n") > 0.1 * titles)).collect()]
    counted.unpersist()
    known = frozenset(w for w, n in often.items() if n >= OUTSIDE * (n + inside.get(w, 0)))
    return words, Forms(names, known, frozenset(endings))


def _pages(texts: DataFrame, fields: list[str], lexicon: dict[str, int], forms: Forms, schema: str, columns: list[tuple[str, pa.DataType]], make, confused: list[tuple[str, str]] | None) -> DataFrame:
    confused = confusions(lexicon) if confused is None else confused
    given = (frozenset(forms.listed), forms.known, forms.endings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, form, forms_ = Lexicon(lexicon, confused), LazyRewriter(), Forms(*given)
        for whole in batches:
            for b in slices(whole, list(range(3, whole.num_columns)), 500):
                data = [b.column(j).to_pylist() for j in range(b.num_columns)]
                form.meet([t for one in data[3:] for t in one if t])
                rows: list[tuple] = []
                for row, title, page, *values in zip(*data, strict=True):
                    # a field that repeats another of its row is read once
                    read = {t: Page(t, lex, form, forms_, title, page) for t in set(values) if t}
                    for f, t in zip(fields, values, strict=True):
                        make(rows, row, f, t, read.get(t))
                made = list(zip(*rows, strict=True)) or [[]] * len(columns)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(made, columns, strict=True)], names=[n for n, _ in columns])

    return texts.select("row_id", "title", "page", *fields).mapInArrow(run, schema)


def notes(texts: DataFrame, fields: list[str], lexicon: dict[str, int], forms: Forms, confused: list[tuple[str, str]] | None = None) -> DataFrame:
    """(row_id, fld, line_no, kind) of every noisy line of the fields; confusions are learnt from the lexicon
    unless they are given."""

    def make(rows: list[tuple], row: int, f: str, t: str | None, page: Page | None) -> None:
        if page is not None:
            rows += [(row, f, n, kind) for n, kind in page.notes()]

    columns = [("row_id", pa.int64()), ("fld", pa.string()), ("line_no", pa.int32()), ("kind", pa.string())]
    return _pages(texts, fields, lexicon, forms, "row_id bigint, fld string, line_no int, kind string", columns, make, confused)


def repair(texts: DataFrame, fields: list[str], lexicon: dict[str, int], forms: Forms, confused: list[tuple[str, str]] | None = None) -> DataFrame:
    """(row_id, fld, repaired) of every field."""

    def make(rows: list[tuple], row: int, f: str, t: str | None, page: Page | None) -> None:
        rows.append((row, f, None if t is None else page.repaired() if page is not None else ""))

    columns = [("row_id", pa.int64()), ("fld", pa.string()), ("repaired", pa.string())]
    return _pages(texts, fields, lexicon, forms, "row_id bigint, fld string, repaired string", columns, make, confused)
