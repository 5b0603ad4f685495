"""The knobs of the search and what it reads of texts: see ``operators/blocks.py`` for the search itself."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from tarnwell.functions import lexicon as L, text as T
from tarnwell.operators import signals


@dataclass(frozen=True)
class Config:
    """Knobs of a search."""

    #: additive signals: weight, and whether scores are scaled by the pool's extremes first
    weights: dict[str, float] = field(default_factory=lambda: {"tfidf": 0.30, "dense": 0.25, "asked": 0.15, "meta": 0.30, "band": 0.0})
    scaled: tuple[str, ...] = ("tfidf", "dense", "asked")
    band_prior: float = 0.40
    quality: bool = True
    #: candidates that each signal names, and candidates kept after fusion
    pool: int = 120
    cut: int = 120
    head: int = 30
    rerank: float = 1.0
    context: int = 70
    selectivity: float = 0.5


def quantity_patterns(table: dict[str, list[str]] = L.QUANTITIES) -> list[tuple[str, str]]:
    return [(q, "|".join(words)) for q, words in sorted(table.items())]


def context_of(query: Column, table: dict[str, list[str]] = L.QUANTITIES) -> Column:
    """The pattern of the first quantity, by name, that a query speaks of; null for none."""
    out = F.lit(None).cast("string")
    for _, pattern in reversed(quantity_patterns(table)):
        out = F.when(F.lower(query).rlike(pattern), F.lit(pattern)).otherwise(out)
    return out


def near(text: Column, context: Column, width: int) -> Column:
    """What stands within ``width`` characters of a mention of the context, parts by lines; the whole text
    where the context is null, nothing where it isn't mentioned."""

    def part(p: Column, i: Column, n: Column) -> Column:
        first, last = i == 0, i == n - 1
        both = F.when(F.length(p) <= 2 * width, p).otherwise(F.concat(F.left(p, F.lit(width)), F.lit("\n"), F.right(p, F.lit(width))))
        return F.when(first & last, "").when(first, F.right(p, F.lit(width))).when(last, F.left(p, F.lit(width))).otherwise(both)

    low = F.lower(text)
    # a pattern that matches nothing keeps the text whole
    parts = F.split(low, F.coalesce(context, F.lit("\\x00")))
    cut = T.let(parts, lambda ps: F.array_join(F.transform(ps, lambda p, i: part(p, i, F.size(ps))), "\n"))
    return F.when(context.isNull(), low).otherwise(cut)


def values_of(query: Column) -> Column:
    """Numbers of a query, written in digits or words."""
    return F.concat(T.numbers(query), T.spelled_numbers(query))


def band(query: Column, text: Column, config: Config) -> Column:
    """How many of the query's values lie in a band that the text states near the quantity asked for."""
    return signals.band_signal(values_of(query), signals.bands(near(text, context_of(query), config.context)), config.selectivity)


def quality(text: Column, key: Column) -> Column:
    """Penalties of reference lists."""
    return F.when(F.lower(text).rlike(r"doi:|et al\."), 0.55).otherwise(1.0) * F.when(F.lower(key).contains("reference"), 0.65).otherwise(1.0)
