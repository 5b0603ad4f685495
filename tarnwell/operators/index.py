"""Lexical index: weighted postings of unigrams and bigrams, and BM25.

Postings are a table (doc, term, w); weights are raw term frequency times ln((1 + n) / (1 + df)) + 1,
normalised to length one per document.  Document frequencies and norms are taken over the whole corpus
before any query restricts the terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarnwell.functions import text as T


def grams(t: Column) -> Column:
    """Unigrams and bigrams of a text, bigrams joined by a blank."""
    w = T.terms(t)
    pairs = lambda x: F.when(F.size(x) > 1, F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return T.let(w, lambda x: F.concat(x, pairs(x)))


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)."""
    return docs.select(key, F.explode(grams(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def question_texts(gold: DataFrame, key: str, query: str, relevance: str) -> DataFrame:
    """(cid, text): of each item that questions are graded for, the questions in the order of their keys."""
    pairs = gold.where(F.col(query).isNotNull()).select(F.col(key).alias("k"), F.col(query).alias("q"), F.explode(F.map_keys(relevance)).alias("cid"))
    return pairs.groupBy("cid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]), " ").alias("text"))


def vocabulary(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, df, idf) over all documents; one row of the corpus size joins by broadcast."""
    n = docs.agg(F.count("*").alias("n_docs"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def weigh(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, term, w): weights of length one per key; terms outside the vocabulary drop out."""
    raw = counts.join(vocab.select("term", "idf"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    # a document's terms are gathered once for its norm and its weights: bounded by its text
    whole = raw.groupBy(key).agg(F.collect_list(F.struct("term", "raw")).alias("x"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return whole.select(key, "norm", F.inline("x")).select(key, "term", (F.col("raw") / F.col("norm")).alias("w"))


def cosine(queries: DataFrame, postings: DataFrame, qkey: str, key: str) -> DataFrame:
    """(qkey, key, score): sparse dot products over shared terms only."""
    q = queries.select(qkey, "term", F.col("w").alias("qw"))
    return q.join(postings, "term").groupBy(qkey, key).agg(F.sum(F.col("qw") * F.col("w")).alias("score"))


def bm25(counts: DataFrame, docs: DataFrame, queries: DataFrame, key: str, qkey: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qkey, key, score) of unigram queries (qkey, term) against (key, term, tf)."""
    lengths = counts.groupBy(key).agg(F.sum("tf").alias("dl"))
    avg = lengths.agg(F.avg("dl").alias("avgdl"), F.count("*").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    hit = queries.select(qkey, "term").distinct().join(counts, "term").join(df, "term").join(lengths, key).crossJoin(F.broadcast(avg))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy(qkey, key).agg(F.sum(idf * tf).alias("score"))
