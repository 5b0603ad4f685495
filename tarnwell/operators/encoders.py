"""Encoders and rerankers behind one interface, and exact dense search by blocks.

An encoder maps lists of terms to vectors of length one.  ``ENCODERS`` is the registry: a name gives its
dimensions, the prefixes of queries and passages and a function that builds the model in a worker; models
are loaded once per worker process and texts come in Arrow batches.  Where no weights are at hand, the
``hashed`` encoder stands in: a signed bag of hashed terms.  ``tokens`` gives a vector for each term, for
late interaction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tarnwell.functions import text as T

#: queries of a search that are held at once; more are searched in blocks of so many
BLOCK = 4_096


class Hashed:
    """A bag of terms, each a signed unit vector chosen by its digest."""

    def __init__(self, dims: int):
        self.dims = dims
        self.known: dict[str, tuple[int, float]] = {}

    def term(self, t: str) -> tuple[int, float]:
        at = self.known.get(t)
        if at is None:
            if len(self.known) > 200_000:
                self.known.clear()
            h = hashlib.md5(t.encode()).hexdigest()
            at = self.known[t] = int(h[:2], 16) % self.dims, 1.0 if int(h[2], 16) < 8 else -1.0
        return at

    def encode(self, terms: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(terms), self.dims))
        for k, some in enumerate(terms):
            for t in some:
                i, sign = self.term(t)
                out[k, i] += sign
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 1e-12)


@dataclass(frozen=True)
class Encoder:
    dims: int
    build: Callable[[int], Hashed]
    query_prefix: str = ""
    passage_prefix: str = ""


ENCODERS = {
    "hashed": Encoder(64, Hashed),
    # one encoder with a role for each side, told apart by prefixes
    "hashed-dual": Encoder(64, Hashed, "query: ", "passage: "),
}


def encoder(name: str) -> Encoder:
    """The registered encoder; an unknown name has no prefixes and the stand-in's model."""
    return ENCODERS.get(name, Encoder(64, Hashed))


def encode(df: DataFrame, key: str, text: str, name: str = "hashed", role: str = "passage") -> DataFrame:
    """(key, v): the vector of each text; texts without terms have a vector of zeros, null texts too."""
    e = encoder(name)
    prefix = e.query_prefix if role == "query" else e.passage_prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = e.build(e.dims)
        for b in batches:
            v = model.encode(b.column(1).to_pylist())
            off = pa.array(np.arange(0, v.size + 1, e.dims, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(off, pa.array(v.ravel()))], names=[key, "v"])

    terms = F.coalesce(T.terms(F.concat(F.lit(prefix), F.col(text))), F.array().cast("array<string>"))
    kind = dict(df.dtypes)[key]
    return df.select(key, terms.alias("terms")).mapInArrow(run, f"`{key}` {kind}, v array<double>")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), dims)


def _held(queries: DataFrame, keys: list[str], block: int) -> Iterator[list]:
    """The rows of a stated query set, about ``block`` of them at once."""
    rows = queries.limit(block + 1).collect()
    if len(rows) <= block:
        yield rows
        return
    blocks = -(-queries.count() // block)
    for k in range(blocks):
        yield queries.where(F.pmod(F.xxhash64(*keys), F.lit(blocks)) == k).collect()


def nearest(queries: DataFrame, vectors: DataFrame, qkey: str, key: str, n: int, columns: tuple[str, ...] = ("v",), block: int = BLOCK, digits: int = 9) -> DataFrame:
    """(qkey, key, score): the ``n`` best of (key, v) for each query by dot product, over all vectors.

    The stated query set is held in blocks of at most ``block`` rows; each batch of vectors meets a block in
    one matrix product and passes on its own best only.  With several query ``columns`` the best of their
    products counts.  Scores are rounded to ``digits``; all that tie at the cut are given, for the caller to settle
    by key; null vectors take no part."""
    qs = queries.select(qkey, *columns).where(" and ".join(f"{c} is not null" for c in columns))
    kinds = dict(qs.dtypes)[qkey], dict(vectors.dtypes)[key]
    schema = f"`{qkey}` {kinds[0]}, `{key}` {kinds[1]}, score double"
    out = None
    for rows in _held(qs, [qkey], block):
        ids = [r[qkey] for r in rows]
        sides = [np.array([list(r[c]) for r in rows], dtype=np.float64) for c in columns]

        def run(batches: Iterator[pa.RecordBatch], ids=ids, sides=sides) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not ids:
                    continue
                v = _matrix(b.column(1), sides[0].shape[1])
                score = sides[0] @ v.T
                for s in sides[1:]:
                    score = np.maximum(score, s @ v.T)
                score = np.round(score, digits)
                keys = b.column(0).to_numpy(zero_copy_only=False)
                if b.num_rows > n:
                    # all that reach the n-th best score: ties are settled by key at the end
                    least = np.partition(score, b.num_rows - n, axis=1)[:, b.num_rows - n]
                    q, at = np.nonzero(score >= least[:, None])
                else:
                    q, at = np.nonzero(np.ones_like(score, dtype=bool))
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q.tolist()]), pa.array(keys[at]), pa.array(score[q, at])], names=[qkey, key, "score"])

        one = vectors.select(key, "v").where("v is not null").mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def maxsim(queries: DataFrame, vectors: DataFrame, qkey: str, token: str, key: str) -> DataFrame:
    """(qkey, key, score): late interaction of query tokens (qkey, token, v) and (key, v): for each query
    token its best dot product with any vector of the key, summed.

    The stated query tokens, at most BLOCK of them at once, meet each batch of vectors in one matrix
    product; a batch passes on one row for each token and key that it holds."""
    qs = queries.select(qkey, token, "v")
    kinds = dict(qs.dtypes), dict(vectors.dtypes)[key]
    schema = f"`{qkey}` {kinds[0][qkey]}, `{token}` {kinds[0][token]}, `{key}` {kinds[1]}, best double"
    out = None
    for rows in _held(qs, [qkey, token], BLOCK):
        side = np.array([list(r.v) for r in rows], dtype=np.float64)

        def run(batches: Iterator[pa.RecordBatch], rows=rows, side=side) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not rows:
                    continue
                score = side @ _matrix(b.column(1), side.shape[1]).T
                keys, first = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
                order = np.argsort(first, kind="stable")
                best = np.maximum.reduceat(score[:, order], np.flatnonzero(np.diff(first[order], prepend=-1)), axis=1)
                n, m = best.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[qkey] for r in rows for _ in range(m)]), pa.array([r[token] for r in rows for _ in range(m)]), pa.array(np.tile(keys, n)), pa.array(best.ravel())],
                    names=[qkey, token, key, "best"],
                )

        one = vectors.select(key, "v").where("v is not null").mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    best = out.groupBy(qkey, token, key).agg(F.max("best").alias("best"))
    return best.groupBy(qkey, key).agg(F.sum("best").alias("score"))


def overlap_rerank(query: Column, text: Column) -> Column:
    """The stand-in of a cross-encoder: the share of distinct terms that query and text have in common."""
    return T.jaccard(F.array_distinct(T.terms(query)), F.array_distinct(T.terms(text)))
