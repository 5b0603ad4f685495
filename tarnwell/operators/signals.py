"""Relevance signals: vectors, late interaction, metadata and numeric bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnwell.functions import text as T


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top(scored: DataFrame, by: str, key: str, n: int, score: str = "score") -> DataFrame:
    """The ``n`` best of each group by falling score, then key; Spark prunes to n per partition first."""
    w = Window.partitionBy(by).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def expand(query: Column, lexicon: dict[str, list[str]]) -> Column:
    """Terms added to a query: those of the triggers it contains that it does not hold already."""
    low = F.lower(query)
    added = F.concat(*[F.when(low.contains(t), F.array(*map(F.lit, ws))).otherwise(F.array().cast("array<string>")) for t, ws in lexicon.items()])
    return F.array_distinct(F.filter(added, lambda w: ~low.contains(w)))


def metadata(query: Column, text: Column, weights: tuple[float, float, float] = (0.40, 0.15, 0.10), stopwords: list[str] = T.STOPWORDS) -> Column:
    """Coverage of the query's content terms as substrings (damped above 600 characters), stated values
    that the query repeats, and shared numbers."""
    low = F.lower(text)
    want = T.content_terms(query, stopwords)
    damp = F.when(F.length(text) > 600, F.sqrt(F.lit(600.0) / F.length(text))).otherwise(1.0)
    coverage = T.let(want, lambda x: F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.filter(x, lambda w: low.contains(w))) / F.size(x))) * damp
    asked = F.lower(F.replace(query, F.lit(" "), F.lit("")))
    exact = F.least(F.size(F.filter(T.stated_values(text), lambda v: asked.contains(v))) / 3.0, F.lit(1.0))
    share = T.let(F.array_distinct(T.numbers(query)), lambda q: F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, T.numbers(text))) / F.size(q)))
    return weights[0] * coverage + weights[1] * exact + weights[2] * share


_NUM = r"([0-9]+(?:\.[0-9]+)?)"
RANGE = rf"{_NUM} ?(?:-|–|to|and) ?{_NUM}"
LOWER = rf"(?:<=?|≤|less than|under|below) ?{_NUM}"
UPPER = rf"(?:>=?|≥|more than|over|above|exceeds) ?{_NUM}"


def bands(text: Column) -> Column:
    """Numeric bands that a text states: closed ranges, [0, x] and [x, infinity)."""

    def extracted(pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(group)), lambda x: x.cast("double"))

    closed = F.zip_with(extracted(RANGE, 1), extracted(RANGE, 2), lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))
    low = F.transform(extracted(LOWER, 1), lambda x: F.struct(F.lit(0.0).alias("lo"), x.alias("hi")))
    high = F.transform(extracted(UPPER, 1), lambda x: F.struct(x.alias("lo"), F.lit(float("inf")).alias("hi")))
    return F.concat(closed, low, high)


def band_signal(values: Column, found: Column, selectivity: float = 0.5) -> Column:
    """Mean over the values of 1 - selectivity + selectivity containing / all bands, where a band contains
    the value."""

    def one(v: Column) -> Column:
        n = F.size(F.filter(found, lambda b: (v >= b["lo"]) & (v <= b["hi"])))
        return F.when(n > 0, (1 - selectivity) + selectivity * n / F.size(found)).otherwise(0.0)

    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + one(v))
    return F.when((F.size(values) == 0) | (F.size(found) == 0), 0.0).otherwise(F.least(total / F.size(values), F.lit(1.0)))

