"""Near-duplicate records with small edits (problem 5): improved consistent weighted sampling.

Texts are brought to the consistent form of problem 2 and become sets of shingles of ``words`` words
with TF-IDF weights (1 + ln tf) (ln((1 + n) / (1 + df)) + 1).  Document frequencies are counted over all
texts in a table of 2^18 hashed counters: its size is fixed, and a collision only makes a weight
smaller, for all texts alike.  Texts of one source with equal sets are one class, known by a digest of
128 bits; only classes are sampled, compared and linked, so a group of copies costs nothing until its
pairs are expanded.  Copies shrink to one row per thousand in the pass that reads them, so a hot class
is no hot partition.

Each class is sampled ``bands * rows`` times by improved consistent weighted sampling: two sets share a
sample with the probability of their weighted Jaccard similarity.  Classes that share all samples of a
band are candidates.  The keys of the bands travel packed, seven bytes each.  A bucket of more than
``BUCKET`` classes is not paired up: its members meet by their rarest shingles, of which any two sets
above the threshold share one (prefix filter, by weight), in salted blocks, so nothing is dropped.

Candidates are verified by weighted Jaccard similarity over the whole sets, with TF-IDF weights or, for
``unit`` weights, as the plain Jaccard similarity; both are given.  Before whole sets travel, one byte
of each shingle's hash bounds the plain similarity from above, which drops pairs that cannot reach the
threshold and no others.

Shingles are kept as 48 bits of a hash: that two different shingles of a pair fall together has a
probability of about 3e-12 for texts of a hundred words.  With 40 bands of 6 a pair of weighted
similarity 0.8 is missed with probability 5e-6, one of 0.75 with 4e-4, one of 0.7 with 0.7 %.

Defined cases: null texts, texts without words and rows without a key are left out; equal texts count as near-duplicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tarnwell.llm.lookalike import LazyRewriter
from tarnwell.llm.texts import WORD, slices
from tarnwell.runtime import cut

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
#: classes of a bucket that are paired up directly; larger buckets go by their rarest shingles
BUCKET = 64
#: classes of a bucket that share a rare shingle and are paired in one task
SALT = 512
COUNTERS = 1 << 18
#: bytes of a shingle's hash
WIDTH = 6
#: hashes, and rows of samples, that a process keeps
KEPT = 400_000
SAMPLED = 60_000
#: classes whose band keys are packed together, and band keys that one task of the meeting gets
PACKED, MET = 16_000, 4_000_000


class Hashes(dict):
    """48-bit hashes of strings, kept up to a bound."""

    def __missing__(self, s: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        h = self[s] = xxhash.xxh3_64_intdigest(s) & 0xFFFFFFFFFFFF
        return h


def shingles(text: str, words: int) -> list[str]:
    """Shingles of a text in its consistent form, in lower case; a shorter text is one shingle."""
    w = WORD.findall(text)
    if words == 1 or not w:
        return w
    return [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]


def packed(x: np.ndarray) -> bytes:
    """Sorted hashes byte by byte: first the lowest bytes of all, then the next."""
    return x.view(np.uint8).reshape(-1, 8)[:, :WIDTH].T.tobytes()


def unpacked(b: bytes) -> np.ndarray:
    n = len(b) // WIDTH
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :WIDTH] = np.frombuffer(b, dtype=np.uint8).reshape(WIDTH, n).T
    return out.view(np.uint64).ravel()


def sets(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(src, id, u, cls, code, n, words, tfs) of every text with words: its class and the first 64 bits of
    it, a code of the source, and for the first of the equal sets of a slice how many they are, the
    packed hashes of the shingles and how often each occurs (up to 127)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, hashed = LazyRewriter(), Hashes()
        for whole in batches:
            for b in slices(whole, [2]):
                texts_ = [t or "" for t in b.column(2).to_pylist()]
                form.meet(texts_)
                lists = [shingles(form(t).lower(), words) for t in texts_]
                n = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
                flat = np.fromiter((hashed[x] for one in lists for x in one), dtype=np.uint64, count=int(n.sum()))
                both, tf = np.unique(np.repeat(np.arange(len(lists), dtype=np.uint64), n) << np.uint64(48) | flat, return_counts=True)
                x = both & np.uint64(0xFFFFFFFFFFFF)
                tfs = np.minimum(tf, 127).astype(np.uint8)
                ends = np.searchsorted(both, np.arange(1, len(lists) + 1, dtype=np.uint64) << np.uint64(48))
                some = np.flatnonzero(n)
                off = np.append(0, ends[some]).tolist()
                own = b.take(pa.array(some))
                sources = own.column(0).to_pylist()
                cls, count, first = [], [], {}
                wide, often = [None] * len(some), [None] * len(some)
                for k, src in enumerate(sources):
                    i, j = off[k], off[k + 1]
                    d = xxhash.xxh3_128_digest((src or "").encode() + b"\0" + x[i:j].tobytes())
                    cls.append(d)
                    at = first.setdefault(d, k)
                    count.append(None)
                    if at == k:
                        count[k], wide[k], often[k] = 0, packed(x[i:j]), tfs[i:j].tobytes()
                    count[at] += 1
                code = [xxhash.xxh32_intdigest(s or "") >> 1 for s in sources]
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0), own.column(1), pa.array([int.from_bytes(d[:8], "big", signed=True) for d in cls], pa.int64()), pa.array(cls, pa.binary()), pa.array(code, pa.int32()),
                        pa.array(count, pa.int32()), pa.array(wide, pa.binary()), pa.array(often, pa.binary()),
                    ],
                    names=["src", "id", "u", "cls", "code", "n", "words", "tfs"],
                )

    schema = "src string, id bigint, u bigint, cls binary, code int, n int, words binary, tfs binary"
    return texts.select("src", "id", "text").where("id is not null").mapInArrow(run, schema)


def slot(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(COUNTERS - 1)).astype(np.int64)


def document_frequencies(sets_: DataFrame) -> tuple[np.ndarray, int]:
    """Hashed counters of the shingles' document frequencies and the number of texts.  At most COUNTERS
    rows reach the driver, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS + 1, dtype=np.int64)
        for b in batches:
            for n, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                np.add.at(total, slot(unpacked(words)), n)
                total[COUNTERS] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["c", "n"])

    got = sets_.where("words is not null").select("n", "words").mapInArrow(run, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS + 1, dtype=np.int64)
    out[got["c"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out[:COUNTERS], int(out[COUNTERS])


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1.0 + n) / (1.0 + df)) + 1.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _log_samples(word: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """ln a of improved consistent weighted sampling for each (word, weight) and each of k samples: r and
    c are Gamma(2, 1), beta uniform, all drawn from a hash of word and sample."""
    draw = _mix(word.astype(np.uint64)[:, None] * np.uint64(0x100000001B3) + np.arange(1, k + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B1))
    u = []
    for part in range(2):  # three uniforms of 21 bits from each draw
        if part:
            draw = _mix(draw)
        u += [(((draw >> np.uint64(21 * j)).astype(np.uint32) & np.uint32(0x1FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-21) for j in range(3)]
    r = -np.log(u[0] * u[1])
    c = np.log(-np.log(u[2] * u[3]))
    t = np.floor(np.log(weight).astype(np.float32)[:, None] / r + u[4])
    return c - r * (t - u[4] + np.float32(1.0))


class Samples:
    """Rows of samples of (word, tf), drawn at first use and kept up to a bound."""

    def __init__(self, idf: np.ndarray, k: int):
        self.idf, self.k = idf, k
        self.table = np.empty((0, k), dtype=np.float32)
        self.keys = np.empty(0, dtype=np.uint64)  # sorted
        self.places = np.empty(0, dtype=np.int64)

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The table and the rows of ``keys`` (word << 8 | tf) in it."""
        distinct, where = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        have = np.zeros(len(distinct), dtype=bool)
        if len(self.keys):
            have = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct
        new = distinct[~have]
        if len(self.keys) + len(new) > SAMPLED and len(self.keys):
            self.__init__(self.idf, self.k)
            return self.rows(keys)
        if len(new):
            word, tf = new >> np.uint64(8), (new & np.uint64(255)).astype(np.float64)
            weight = (1.0 + np.log(tf)) * self.idf[slot(word)]
            start = len(self.keys)
            if start + len(new) > len(self.table):
                grown = np.empty((max(start + len(new), 2 * len(self.table)), self.k), dtype=np.float32)
                grown[:start] = self.table[:start]
                self.table = grown
            for i in range(0, len(new), 256):  # small enough for the processor's cache
                self.table[start + i : start + i + 256][: len(new) - i] = _log_samples(word[i : i + 256], weight[i : i + 256], self.k)
            keys_, places = np.concatenate([self.keys, new]), np.concatenate([self.places, np.arange(start, start + len(new))])
            order = np.argsort(keys_, kind="stable")
            self.keys, self.places = keys_[order], places[order]
            at = np.searchsorted(self.keys, distinct)
        return self.table, self.places[at][where]


def band_keys(classes: DataFrame, idf: np.ndarray, parts: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(p, base, keys): the hashed samples of each band of each class, of up to PACKED classes at once and
    for each part of ``parts``: two bytes of the class's number above ``base`` and five of the key, byte
    by byte."""
    k_all = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = Samples(idf, k_all)
        nums: list[np.ndarray] = []
        keys: list[np.ndarray] = []

        def passed() -> pa.RecordBatch:
            num, key = np.concatenate(nums), np.concatenate(keys)
            base = int(num[0])
            at = np.repeat((num - base).astype(np.uint16), bands)
            key = key.ravel()
            part = (key % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, at, key = part[order], at[order], key[order] >> np.uint64(24)
            stops = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)).tolist()
            blobs, start = [], 0
            for stop in stops:
                blobs.append(at[start:stop].view(np.uint8).reshape(-1, 2).T.tobytes() + key[start:stop].view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes())
                start = stop
            nums.clear(), keys.clear()
            which = part[np.asarray(stops) - 1]
            return pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.full(len(which), base)), pa.array(blobs, pa.binary())], names=["p", "base", "keys"])

        for whole in batches:
            for b in slices(whole, [2], 2000, 2_400_000):
                num = b.column(0).to_numpy()
                parts_ = [unpacked(x) for x in b.column(2).to_pylist()]
                off = np.append(0, np.cumsum([len(x) for x in parts_]))
                words = np.concatenate(parts_)
                tfs = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint8).astype(np.uint64)
                table, where = samples.rows(words << np.uint64(8) | tfs)
                least = np.empty((len(num), k_all), dtype=np.float32)
                for i in range(0, len(num), 64):
                    j = min(i + 64, len(num))
                    least[i:j] = np.minimum.reduceat(table[where[off[i] : off[j]]], off[i:j] - off[i], axis=0)
                # equal samples have equal values, bit for bit: the least value names the sample
                named = least.view(np.uint32).reshape(len(num), bands, rows)
                code = b.column(1).to_numpy().astype(np.uint64)
                key = _mix(code[:, None] * np.uint64(bands) + np.arange(bands, dtype=np.uint64)[None, :])
                for j in range(rows):
                    key = _mix(key ^ named[:, :, j].astype(np.uint64))
                if nums and (num[-1] - nums[0][0] >= 1 << 16 or sum(map(len, nums)) >= PACKED):
                    yield passed()
                nums.append(num), keys.append(key)
        if nums:
            yield passed()

    return classes.select("num", "code", "words", "tfs").mapInArrow(run, "p int, base bigint, keys binary")


def _rarest_first(classes: DataFrame, df: np.ndarray, idf: np.ndarray, threshold: float, weights: str) -> DataFrame:
    """(u, w): of each class the rarest shingles, until what is left weighs less than the threshold's share
    of the whole: two sets whose similarity reaches the threshold have one of them in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, ws = [], []
            for u, words, tfs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = unpacked(words)
                order = np.lexsort((x, df[slot(x)]))
                weight = np.ones(len(x)) if weights == "unit" else _weights(x, tfs, idf)
                left = weight.sum() - np.append(0.0, np.cumsum(weight[order]))
                n = min(len(x), int(np.argmax(left < threshold * left[0] - 1e-9)) or 1)
                ws.append(x[order[:n]].astype(np.int64))
                us.append(np.full(n, u, dtype=np.int64))
            cat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cat(us)), pa.array(cat(ws))], names=["u", "w"])

    return classes.select(F.col("num").alias("u"), "words", "tfs").mapInArrow(run, "u bigint, w bigint")


def _starts(k: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)


def _meet(keys: DataFrame, parts: int, bucket: int) -> DataFrame:
    """(hot, a, b): each pair a < b of a bucket; of a bucket above the limit its members instead, as (true,
    key, class).  What a task holds is bounded: when it has more than MET keys, those of buckets that are
    crowded already are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks: list[np.ndarray] = []
        us: list[np.ndarray] = []
        crowded = np.empty(0, dtype=np.uint64)
        held, limit = 0, MET

        def hot_out() -> pa.RecordBatch:
            """Sort what is held, and pass on the members of crowded buckets."""
            nonlocal ks, us, crowded, held
            k, u = np.concatenate(ks), np.concatenate(us)
            order = np.lexsort((u, k))
            k, u = k[order], u[order]
            at = _starts(k)
            size = np.diff(np.append(at, len(k)))
            crowded = np.union1d(crowded, k[at[size > bucket]])
            hot = np.isin(k, crowded)
            ks, us = [k[~hot]], [u[~hot]]
            held = len(ks[0])
            return _met(np.ones(int(hot.sum()), dtype=bool), k[hot].view(np.int64), u[hot])

        for b in batches:
            for p, base, blob in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                n = len(blob) // 7
                raw = np.frombuffer(blob, dtype=np.uint8)
                at = raw[: 2 * n].reshape(2, n).T.copy().view(np.uint16).ravel()
                wide = np.zeros((n, 8), dtype=np.uint8)
                wide[:, :5] = raw[2 * n :].reshape(5, n).T
                ks.append(wide.view(np.uint64).ravel() | np.uint64(p) << np.uint64(40))
                us.append(at.astype(np.int64) + base)
                held += n
            if held > limit:
                yield hot_out()
                limit = max(MET, 2 * held)
        if not ks:
            return
        yield hot_out()
        k, u = ks[0], us[0]
        a, b_ = [], []
        at = np.arange(len(k))
        for d in range(1, bucket):  # pairs d places apart in a bucket
            at = at[at + d < len(k)]
            at = at[k[at] == k[at + d]]
            if not len(at):
                break
            a.append(u[at]), b_.append(u[at + d])
        if a:
            a, b_ = np.concatenate(a), np.concatenate(b_)
            order = np.lexsort((b_, a))
            a, b_ = a[order], b_[order]
            own = np.concatenate([[True], (a[1:] != a[:-1]) | (b_[1:] != b_[:-1])]) & (a < b_)
            for i in range(0, len(a), 100_000):
                some = own[i : i + 100_000]
                yield _met(np.zeros(int(some.sum()), dtype=bool), a[i : i + 100_000][some], b_[i : i + 100_000][some])

    return keys.repartition(parts, "p").mapInArrow(run, "hot boolean, a bigint, b bigint")


def _met(hot: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hot), pa.array(a), pa.array(b)], names=["hot", "a", "b"])


def candidates(classes: DataFrame, df: np.ndarray, n: int, threshold: float, bands: int, rows: int, weights: str = "tfidf", bucket: int = BUCKET, salt: int = SALT) -> DataFrame:
    """(a, b): pairs of numbers of classes (num, u, code, words, tfs), a < b, that share a band."""
    idf = inverse(df, n)
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(classes.count() * bands / MET))
    met = cut(_meet(band_keys(classes, idf, parts, bands, rows), parts, bucket))
    pairs = met.where("not hot").select("a", "b")
    hot = met.where("hot").select(F.col("a").alias("k"), F.col("b").alias("u"))
    if not hot.isEmpty():
        # numbers are turned into ``u`` first, by which the words are parted already
        own = classes.select("num", "u").join(hot.select(F.col("u").alias("num")).distinct().hint("merge"), "num", "left_semi")
        members = classes.join(own.select("u").hint("merge"), "u", "left_semi")
        shared = cut(hot.distinct().join(_rarest_first(members, df, idf, threshold, weights).distinct(), "u"))
        # members of one bucket and shingle meet in blocks of about ``salt`` by ``salt``
        blocks = shared.groupBy("k", "w").agg(F.ceil(F.count("*") / salt).cast("int").alias("s")).where("s > 0")
        own = shared.join(blocks, ["k", "w"]).withColumn("i", F.pmod(F.xxhash64("u"), "s").cast("int"))
        others = F.sequence(F.lit(0), F.col("s") - 1)
        x = own.select("k", "w", F.col("u").alias("x"), "i", F.explode(others).alias("j"))
        y = own.select("k", "w", F.col("u").alias("y"), F.col("i").alias("j"), F.explode(others).alias("i"))
        crowded = x.join(y, ["k", "w", "i", "j"]).where("x < y")
        pairs = pairs.unionByName(crowded.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return pairs.distinct()


def _bounded(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of those pairs whose plain similarity can reach the threshold, by one byte of each hash: the
    bytes in common are at least the shingles in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, [2, 3], 2000):
                m = b.num_rows
                counts = []
                for j in (2, 3):
                    col = b.column(j).to_pylist()
                    size = np.fromiter(map(len, col), dtype=np.int64, count=m)
                    flat = np.frombuffer(b"".join(col), dtype=np.uint8)
                    counts.append((size, np.bincount(np.repeat(np.arange(m) * 256, size) + flat, minlength=m * 256).reshape(m, 256)))
                (na, ca), (nb, cb) = counts
                common = np.minimum(ca, cb).sum(axis=1)
                keep = common >= threshold * (na + nb - common) - 1e-9
                yield b.select([0, 1]).filter(pa.array(keep))

    return pairs.select("a", "b", "bytes_a", "bytes_b").mapInArrow(run, "a bigint, b bigint")


def _weights(x: np.ndarray, tfs: bytes, idf: np.ndarray) -> np.ndarray:
    return (1.0 + np.log(np.frombuffer(tfs, dtype=np.uint8).astype(np.float64))) * idf[slot(x)]


def _verified(pairs: DataFrame, idf: np.ndarray, threshold: float, weights: str) -> DataFrame:
    """(a, b, similarity, weighted) of the pairs that reach the threshold: classes, plain and weighted
    Jaccard similarity over the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for a, b, wa, wb, ta, tb in zip(*(batch.column(j).to_pylist() for j in range(6)), strict=True):
                x, y = unpacked(wa), unpacked(wb)
                both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                plain = len(both) / (len(x) + len(y) - len(both))
                if weights == "unit" and plain < threshold - 1e-12:
                    continue
                vx, vy = _weights(x, ta, idf), _weights(y, tb, idf)
                low = np.minimum(vx[i], vy[j]).sum()
                weighted = float(low / (vx.sum() + vy.sum() - low))
                if weights == "unit" or weighted >= threshold - 1e-12:
                    for col, v in zip(out, (a, b, plain, weighted), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())], names=["a", "b", "similarity", "weighted"])

    both = pairs.select("cls_a", "cls_b", "words_a", "words_b", "tfs_a", "tfs_b")
    return both.mapInArrow(run, "a binary, b binary, similarity double, weighted double")


def near_classes(texts: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, weights: str = "tfidf", bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Membership (src, id, cls) of every row with words in its class of equal sets, and the links (a, b,
    similarity, weighted) between classes of one source that reach the threshold."""
    every = sets(texts, words).persist()
    df, n = document_frequencies(every)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The words of each class travel once; what is joined by ``u`` later comes to them.
    rows_ = every.where("words is not null").select("u", "cls", "code", "words", "tfs").repartition(parts, "u")
    # Any member stands for its class: the words are the same, and the counts of one are taken.
    one = rows_.groupBy("u", "cls").agg(F.max(F.struct("code", "words", "tfs")).alias("x")).sortWithinPartitions("u", "cls")
    classes = one.select(F.monotonically_increasing_id().alias("num"), "u", "cls", "x.code", "x.words", "x.tfs").persist()
    idf = inverse(df, n)

    def at(pairs: DataFrame, side: str, own: DataFrame) -> DataFrame:
        return pairs.join(own.withColumnsRenamed({c: f"{c}_{side}" for c in own.columns if c != "u"}).withColumnRenamed("u", side).hint("merge"), side)

    met = candidates(classes, df, n, threshold, bands, rows, weights)
    ids = classes.select("num", "u")
    for side in ("a", "b"):
        met = met.withColumnRenamed(side, "num").join(ids.hint("merge"), "num").drop("num").withColumnRenamed("u", side)
    if weights == "unit":
        low = classes.select("u", F.expr(f"substring(words, 1, int(length(words) / {WIDTH}))").alias("bytes"))
        met = _bounded(at(at(met, "a", low), "b", low), threshold)
    whole = classes.select("u", "cls", "words", "tfs")
    # Unlike classes with one ``u`` all join, and only true pairs are kept.
    links = cut(_verified(at(at(met, "a", whole), "b", whole), idf, threshold, weights))
    member = cut(every.select("src", "id", "cls"))
    classes.unpersist()
    every.unpersist()
    return member, links


def near_pairs(texts: DataFrame, **options) -> DataFrame:
    """(src, id_a, id_b): every pair of rows of one source that are near-duplicates."""
    member, links = near_classes(texts, **options)
    own = member.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    x = member.select(F.col("cls").alias("a"), "src", F.col("id").alias("x"))
    y = member.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    return (
        links.select("a", "b").unionByName(own).join(x, "a").join(y, "b").where("a <> b or x < y")
        .select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )


def near_groups(texts: DataFrame, **options) -> DataFrame:
    """(src, id, class_id, links): one row per row with words; ``class_id`` is the least class of equal
    sets in its connected component, ``links`` the number of other rows it is a near-duplicate of."""
    member, links = near_classes(texts, **options)
    member, links = member.withColumn("u", F.hex("cls")), links.select(F.hex("a").alias("a"), F.hex("b").alias("b"))
    sizes = member.groupBy("u").agg(F.count("*").alias("n"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(sizes.withColumnRenamed("u", "b"), "b").groupBy(F.col("a").alias("u")).agg(F.sum("n").alias("beside"))
    labels = components(both)
    every = member.join(sizes, "u").join(degree, "u", "left").join(labels, "u", "left")
    return every.select("src", "id", F.coalesce("label", "u").alias("class_id"), (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("links"))


def components(links: DataFrame) -> DataFrame:
    """(u, label): connected components of symmetric links (a, b) by alternating large-star and
    small-star steps, which need O(log n) rounds; lineage is cut in the shared folder each round."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    while True:
        # large star: every larger neighbour is linked to the least neighbour or the node itself
        near = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = near.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = near.join(least, "x").where("y > x and y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # small star: every smaller neighbour, and the node, is linked to the least of them
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select("x", F.col("m").alias("y"))).distinct()
        new = cut(small.where("x <> y"))
        if new.count() == edges.count() and new.join(edges, ["x", "y"], "left_anti").isEmpty():
            break
        edges = new
    roots = edges.select(F.col("y").alias("u")).distinct()
    return edges.select(F.col("x").alias("u"), F.col("y").alias("label")).unionByName(roots.select("u", F.col("u").alias("label")))
