"""Same or near-same records across splits (problem 4): automata over evaluation passages.

Texts become sequences of words; records of one side with equal sequences are one class, so copies are
scanned once.  The passages of an evaluation class are its runs of ``PASSAGE`` words and its rarest
single words.  Passages are sharded by a hash of their rarest word, by counts over all classes; each
shard's passages form one Aho-Corasick automaton over normalised text, and the training classes that
can hold one of them stream past it: those with the rarest word of one of their own runs in the shard.
Training texts so travel to a handful of shards, whatever the number of shards, and words that only one
side has travel nowhere.

A training class that shows a rare word of an evaluation class, rare in both, is compared with it: of
two sets whose Jaccard similarity is at least the threshold, the |set| - ceil(threshold |set|) + 1
rarest words of the one meet those of the other, so no overlap is missed.  Matched passages are merged
as intervals of the evaluation record into the share of it that the training split covers.

A word of more than ``BLOCK`` classes, such as one that a third of all records share, has shards of its
own, in which blocks of both sides meet by hash; what a task holds is bounded.

Defined cases: null queries, queries without words and records without a key take no part; null slices
of the main table take no part; records of other slices than the training and evaluation ones take no
part; a record shorter than a passage is covered by an equal sequence of words only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tarnwell.llm.texts import WORD, slices
from tarnwell.runtime import cut

THRESHOLD = 0.7
PASSAGE = 5
#: a shard for so many evaluation classes; a word of more classes is split into blocks of so many
SHARD, BLOCK = 50, 5_000
COUNTERS = 1 << 18


def _slot(word: str) -> int:
    """The counter of a word: the same hash as the engine's ``xxhash64``."""
    return xxhash.xxh64_intdigest(word, seed=42) & (COUNTERS - 1)


def _class(words: str) -> bytes:
    return xxhash.xxh3_128_digest(words)


def _records(rows: DataFrame) -> DataFrame:
    """(slice, source, key, cls, words): rows with words, their class and their words in order, parted by
    blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, [3]):
                words = [" ".join(WORD.findall(t.lower())) for t in b.column(3).to_pylist()]
                some = [k for k, w in enumerate(words) if w]
                own = b.take(pa.array(some, pa.int64()))
                kept = [words[k] for k in some]
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:3], pa.array(list(map(_class, kept)), pa.binary()), pa.array(kept, pa.string())],
                    names=["slice", "source", "key", "cls", "words"],
                )

    given = rows.select("slice", "source", "key", "text").where("text is not null and key is not null and slice is not null")
    kind = dict(given.dtypes)["key"]
    return given.mapInArrow(run, f"slice string, source string, key {kind}, cls binary, words string")


def _counts(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many evaluation and training classes words occur, in tables of hashed counters of fixed size."""
    slot = F.col("w").bitwiseAND(F.lit(COUNTERS - 1)).cast("int").alias("c")
    words = classes.select("train", F.explode(F.transform(F.array_distinct(F.split("words", " ")), lambda w: F.xxhash64(w))).alias("w"))
    out = np.zeros((2, COUNTERS), dtype=np.int64)
    pdf = words.groupBy("train", slot).agg(F.count("*").alias("n")).toPandas()  # at most 2 x COUNTERS rows
    out[pdf["train"].to_numpy(dtype=np.int64), pdf["c"].to_numpy(dtype=np.int64)] = pdf["n"].to_numpy(dtype=np.int64)
    return out[0], out[1]


def rarest(words: list[str], order: dict[str, tuple[int, str]], threshold: float, passage: int) -> tuple[list[str], list[str]]:
    """The rarest distinct words, rarest first, as many as any overlap must touch; and the rarest word of
    each run in order."""
    by = sorted(order, key=order.__getitem__)
    n = len(by)
    size = min(passage, len(words))
    runs = [min(words[at : at + size], key=order.__getitem__) for at in range(len(words) - size + 1)]
    return by[: n - math.ceil(threshold * n - 1e-9) + 1], runs


def _routed(classes: DataFrame, counts: tuple[np.ndarray, np.ndarray], shards: int, threshold: float, passage: int, block: int) -> DataFrame:
    """(shard, train, words, rare, runs): each class once for every shard of its rarest words that the
    other side has, with its rare words that belong to the shard, each by its place and its rank, and the
    places of its runs that do."""
    total = counts[0] + counts[1]

    def places(some: list[int]) -> bytes:
        return np.asarray(some, dtype=np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for train, c, t in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                words = t.split(" ")
                slots = {w: _slot(w) for w in words}
                few, runs = rarest(words, {w: (int(total[s]), w) for w, s in slots.items()}, threshold, passage)
                met: dict[int, tuple[list[int], list[int]]] = {}
                first = {w: k for k, w in zip(range(len(words) - 1, -1, -1), reversed(words), strict=True)}
                homes: dict[str, list[int]] = {}
                for w in {*few, *runs}:
                    s = slots[w]
                    if not counts[0 if train else 1][s]:
                        continue
                    n = -(-int(total[s]) // block)
                    if n == 1:
                        homes[w] = [s % shards]
                    else:  # blocks (i, j) of evaluation and training classes
                        own = int.from_bytes(c[:4], "big") % n
                        homes[w] = [shards + xxhash.xxh64_intdigest(f"{w} {k if train else own} {own if train else k}") % (1 << 62) for k in range(n)]
                for rank, w in enumerate(few):
                    for h in homes.get(w, ()):
                        met.setdefault(h, ([], []))[0].extend((first[w], rank))
                for at, w in enumerate(runs):
                    for h in homes.get(w, ()):
                        met.setdefault(h, ([], []))[1].append(at)
                for h, (rare, of) in met.items():
                    for col, v in zip(out, (h, train, t, places(rare), b"" if train else places(of)), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.bool_(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["shard", "train", "words", "rare", "runs"])

    return classes.select("train", "cls", "words").mapInArrow(run, "shard bigint, train boolean, words string, rare binary, runs binary")


def merge(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Shard:
    """The automaton of a shard's evaluation passages, and what it met in the training classes."""

    def __init__(self, records: list[tuple[str, bytes, bytes]], threshold: float, passage: int):
        self.threshold, self.passage = threshold, passage
        self.names = [_class(r[0]) for r in records]
        self.texts = [r[0].split(" ") for r in records]
        self.sets = [frozenset(t) for t in self.texts]
        self.passages: dict[str, list[tuple[int, int]]] = {}  # passage -> (record, position)
        self.short: dict[str, list[int]] = {}
        rare: dict[str, list[tuple[int, int, int]]] = {}
        for i, (words, (t, some, runs)) in enumerate(zip(self.texts, records, strict=True)):
            n = len(self.sets[i])
            for k, rank in np.frombuffer(some, dtype=np.uint32).reshape(-1, 2).tolist():
                rare.setdefault(words[k], []).append((i, n, n - rank))
            if len(words) < passage:
                self.short.setdefault(t, []).append(i)
                continue
            for at in np.frombuffer(runs, dtype=np.uint32).tolist():
                self.passages.setdefault(" ".join(words[at : at + passage]), []).append((i, at))
        #: rare word -> records, their sizes, and how many of their words aren't rarer
        self.rare = {w: np.array(some).T for w, some in rare.items()}
        automaton = ahocorasick.Automaton()
        for p in self.passages:
            automaton.add_word(f" {p} ", (False, p))
        for w in self.rare:
            automaton.add_word(f" {w} ", (True, w))
        automaton.make_automaton()
        self.automaton = automaton
        self.seen: set[str] = set()
        self.whole: set[int] = set()

    def scan(self, text: str, rare: bytes, pairs: list[tuple]) -> None:
        words = text.split(" ")
        own = {words[k]: rank for k, rank in np.frombuffer(rare, dtype=np.uint32).reshape(-1, 2).tolist()}
        have = frozenset(words)
        size, t = len(have), self.threshold
        met: set[int] = set()
        for _, (single, p) in self.automaton.iter(f" {text} "):
            if not single:
                self.seen.add(p)
            elif p in own:
                # At the first word that two sets share, by rarity, what is left of both must do.
                i, n, left = self.rare[p]
                met.update(i[np.minimum(left, size - own[p]) * (1 + t) >= t * (n + size) - 1e-9].tolist())
        if text in self.short:
            self.whole.update(self.short[text])
        for i in met:
            n = len(self.sets[i])
            common = len(self.sets[i] & have)
            if common >= t * (n + size - common) - 1e-9:
                pairs.append((self.names[i], _class(text), common / (n + size - common), None))

    def spans(self) -> list[tuple]:
        """Of each record that was met, the merged intervals of its words that training passages hold."""
        cover: dict[int, list[tuple[int, int]]] = {i: [(0, len(self.texts[i]))] for i in self.whole}
        for p in self.seen:
            for i, at in self.passages[p]:
                cover.setdefault(i, []).append((at, at + self.passage))
        return [(self.names[i], None, None, [list(s) for s in merge(some)]) for i, some in cover.items()]


def _scanned(routed: DataFrame, threshold: float, passage: int) -> DataFrame:
    """From rows sorted by shard, evaluation classes first: (eval_cls, train_cls, similarity, null) of
    overlaps and (eval_cls, null, null, spans) of what was met.  Only a shard's evaluation classes are
    held; training classes stream past."""
    kinds = (pa.binary(), pa.binary(), pa.float64(), pa.list_(pa.list_(pa.int32())))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["eval_cls", "train_cls", "similarity", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, records, shard = None, [], None
        for whole in batches:
            out: list[tuple] = []
            for h, train, text, rare, runs in zip(*(whole.column(j).to_pylist() for j in range(5)), strict=True):
                if h != at:
                    out += shard.spans() if shard else []
                    at, records, shard = h, [], None
                if not train:
                    records.append((text, rare, runs))
                    continue
                if shard is None:
                    if not records:
                        continue
                    shard, records = Shard(records, threshold, passage), []
                shard.scan(text, rare, out)
            yield batch(out)
        if shard:
            yield batch(shard.spans())

    ordered = routed.repartition(int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "train")
    return ordered.mapInArrow(run, "eval_cls binary, train_cls binary, similarity double, spans array<array<int>>")


def scan(rows: DataFrame, train: str, threshold: float = THRESHOLD, passage: int = PASSAGE, shard: int = SHARD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The records of (slice, source, key, text) and what the automata found between their classes."""
    records = cut(_records(rows))
    classes = cut(records.groupBy((F.col("slice") == train).alias("train"), "cls").agg(F.min("words").alias("words")))
    counts = _counts(classes)
    shards = max(1, math.ceil(classes.where("not train").count() / shard))
    routed = _routed(classes, counts, shards, threshold, passage, block)
    return records, cut(_scanned(routed, threshold, passage))


def _coverage(records: DataFrame, found: DataFrame, train: str) -> DataFrame:
    """(eval_cls, coverage): the share of an evaluation class's words that training passages cover.  Spans
    are merged per block already, and only distinct ones of one class meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sum(y - x for x, y in merge([(s["a"], s["b"]) for s in some])) for some in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int32())], names=["eval_cls", "covered"])

    spans = found.where("spans is not null").select("eval_cls", F.explode("spans").alias("s")).select("eval_cls", F.struct(F.col("s")[0].alias("a"), F.col("s")[1].alias("b")).alias("s"))
    covered = spans.groupBy("eval_cls").agg(F.collect_set("s").alias("s")).mapInArrow(run, "eval_cls binary, covered int")
    size = records.where(F.col("slice") != train).groupBy(F.col("cls").alias("eval_cls")).agg(F.max(F.size(F.split("words", " "))).alias("size"))
    return size.join(covered, "eval_cls", "left").select("eval_cls", (F.coalesce("covered", F.lit(0)) / F.col("size")).alias("coverage"))


def _pairs(found: DataFrame) -> DataFrame:
    return found.where("train_cls is not null").select("eval_cls", "train_cls", "similarity").distinct()


def overlaps(rows: DataFrame, train: str = "dev", **options) -> DataFrame:
    """(slice, source, eval_key, train_key, similarity, coverage): all cross-split overlaps, slice and
    source of the evaluation record, and the share of it that the training split covers."""
    records, found = scan(rows, train, **options)
    e = records.where(F.col("slice") != train).select(F.col("cls").alias("eval_cls"), "slice", "source", F.col("key").alias("eval_key"))
    t = records.where(F.col("slice") == train).select(F.col("cls").alias("train_cls"), F.col("key").alias("train_key"))
    pairs = _pairs(found).join(_coverage(records, found, train), "eval_cls")
    return pairs.join(e, "eval_cls").join(t, "train_cls").select("slice", "source", "eval_key", "train_key", "similarity", "coverage")


def report(rows: DataFrame, train: str = "dev", **options) -> DataFrame:
    """(slice, source, records, overlapping, exact, mean_coverage) of the evaluation records; exact ones
    have all words in common with a training record."""
    records, found = scan(rows, train, **options)
    near = _pairs(found).groupBy("eval_cls").agg(F.max((F.col("similarity") == 1.0).cast("int")).alias("exact"))
    e = records.where(F.col("slice") != train).select(F.col("cls").alias("eval_cls"), "slice", "source")
    each = e.join(_coverage(records, found, train), "eval_cls").join(near, "eval_cls", "left")
    return each.groupBy("slice", "source").agg(
        F.count("*").alias("records"), F.count("exact").alias("overlapping"), F.coalesce(F.sum("exact"), F.lit(0)).alias("exact"),
        F.round(F.avg("coverage"), 6).alias("mean_coverage"),
    )
