"""Score fusion, priors, reranking and selection over (group, item, scores)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def minmax(scored: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Columns scaled to [0, 1] per group; a range below 1e-12 gives 0, a null gives 0.

    Extremes are aggregated with map-side combine and joined back, so a hot group needs no window."""
    ends = scored.groupBy(by).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    both = scored.join(ends, by)
    for c in columns:
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        both = both.withColumn(c, F.when(span > 1e-12, F.coalesce((F.col(c) - F.col(f"lo_{c}")) / span, F.lit(0.0))).otherwise(0.0))
    return both.select(*scored.columns)


def convex(scored: DataFrame, by: str, weights: dict[str, float]) -> DataFrame:
    """``fused``: weighted mean of min-max scaled scores over the signals that are active in the group
    (have any score there)."""
    active = scored.groupBy(by).agg(*[(F.count(c) > 0).cast("double").alias(f"on_{c}") for c in weights])
    scaled = minmax(scored, by, list(weights)).join(active, by)
    top = sum(F.col(c) * w * F.col(f"on_{c}") for c, w in weights.items())
    bottom = sum(F.col(f"on_{c}") * w for c, w in weights.items())
    return scaled.withColumn("fused", F.when(bottom > 0, top / bottom).otherwise(0.0)).drop(*[f"on_{c}" for c in weights])


def reciprocal_rank(scored: DataFrame, by: str, key: str, columns: list[str], k: int = 60, depth: int = 120) -> DataFrame:
    """``rrf``: sum over signals of 1 / (k + rank) within the first ``depth``, scaled by the group's best."""
    parts = []
    for c in columns:
        w = Window.partitionBy(by).orderBy(F.desc(c), key)
        ranked = scored.where(F.col(c).isNotNull()).select(by, key, F.row_number().over(w).alias("r")).where(F.col("r") <= depth)
        parts.append(ranked.select(by, key, (1.0 / (k + F.col("r"))).alias("part")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    summed = both.groupBy(by, key).agg(F.sum("part").alias("raw"))
    best = summed.groupBy(by).agg(F.max("raw").alias("best"))
    return summed.join(best, by).select(by, key, (F.col("raw") / F.col("best")).alias("rrf"))


def rerank_blend(fused: DataFrame, by: str, key: str, rerank: str, weight: float = 1.0, head: int = 30, compat: bool = False) -> DataFrame:
    """Blend a second score into the first ``head`` items of each group.  The rest is scaled alike; with
    ``compat`` it keeps its unscaled score and may overtake the head."""
    w = Window.partitionBy(by).orderBy(F.desc("fused"), key)
    ranked = fused.withColumn("rank", F.row_number().over(w))
    first = minmax(ranked.where(F.col("rank") <= head), by, [rerank]).withColumn("final", (F.col("fused") + weight * F.col(rerank)) / (1 + weight))
    rest = ranked.where(F.col("rank") > head).withColumn("final", F.col("fused") if compat else F.col("fused") / (1 + weight))
    return first.unionByName(rest)


def static_diversify(scored: DataFrame, by: str, key: str, section: str, score: str, decay: float = 0.80) -> DataFrame:
    """Greedy diversification without exemptions, as a window: a section's n-th item by score is damped
    by decay^(n - 1)."""
    w = Window.partitionBy(by, section).orderBy(F.desc(score), key)
    return scored.withColumn("diverse", F.col(score) * F.pow(F.lit(decay), F.row_number().over(w) - 1))


def diversify(pool: DataFrame, by: str, key: str, section: str, score: str, values: str, n: int = 10, decay: float = 0.80) -> DataFrame:
    """Greedy selection of ``n`` items per group: each further item of a section is damped, unless it
    states a value that no selected item of its section states.  Pools are cut to a fixed size before
    (see ``signals.top``), so a group fits in one task."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values([score, key], ascending=[False, True]).to_dict("records")
        seen: dict = {}
        said: dict = {}
        chosen = []
        while rows and len(chosen) < n:
            best, most = None, float("-inf")
            for r in rows:
                s = r[section]
                fresh = set(r[values] if r[values] is not None else ()) - said.get(s, set())
                worth = r[score] * (1.0 if fresh else decay ** seen.get(s, 0))
                if worth > most:
                    best, most = r, worth
            rows.remove(best)
            s = best[section]
            seen[s] = seen.get(s, 0) + 1
            said.setdefault(s, set()).update(best[values] if best[values] is not None else ())
            chosen.append((best[by], len(chosen) + 1, best[key], most))
        return pd.DataFrame(chosen, columns=["by", "position", "item", "worth"])

    kinds = dict(pool.dtypes)
    out = pool.select(by, key, section, score, values).groupBy(by).applyInPandas(pick, f"by {kinds[by]}, position int, item {kinds[key]}, worth double")
    return out.withColumnsRenamed({"by": by, "item": key})


def fold_priors(base: Column, priors: list[Column]) -> Column:
    """A score times its multiplicative priors, in order."""
    for p in priors:
        base = base * p
    return base
