"""One ranking from several differently-scaled scores (problem 3): median rank aggregation.

Every item's rank in each score is counted within its group (1 is best; equal scores share the best
rank).  Items that lack a score stand behind all that have it.  Items are ordered by the weighted
median of their ranks, then by their mean rank, then by identifier.  Only ranks enter, so neither
range nor distribution of a score matters.

Groups are counted first.  Those of usual size are ranked by windows behind one shuffle.  A group above
``HOT_ROWS`` never meets one task: per group and score, approximate quantiles part the *distinct* scores
into buckets, ranks are counted inside the buckets and shifted by the sizes of the buckets above.  Both
ways are exact and give the same ranks; the quantiles only balance the work.

Defined cases: a null or NaN score is a missing one; rows loaded twice count once, the largest score
of an item counts; items without any score come last; rows without an item take no part; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 64
HOT_ROWS = 200_000


def ranks(long: DataFrame, by: list[str], score: str = "score", item: str = "item", buckets: int = BUCKETS) -> DataFrame:
    """(*by, item, rank): competition ranks of ``item`` by falling ``score`` within ``by``.

    Rows with null scores are left out."""
    s = long.where(F.col(score).isNotNull() & ~F.isnan(score)).select(*by, F.col(item).alias("item"), F.col(score).cast("double").alias("score"))
    values = s.groupBy(*by, "score").agg(F.count("*").alias("n"))
    edges = values.groupBy(*by).agg(F.percentile_approx("score", [i / buckets for i in range(1, buckets)], 1000).alias("edges"))
    placed = values.join(edges, by).select(*by, "score", "n", F.size(F.filter("edges", lambda e: e > F.col("score"))).alias("bucket"))
    sizes = placed.groupBy(*by, "bucket").agg(F.sum("n").alias("size"))
    above = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*by, "bucket", F.coalesce(F.sum("size").over(above), F.lit(0)).alias("shift"))
    within = Window.partitionBy(*by, "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(shifts, [*by, "bucket"]).select(
        *by, "score", (F.col("shift") + F.coalesce(F.sum("n").over(within), F.lit(0)) + 1).alias("rank")
    )
    return s.join(ranked, [*by, "score"]).select(*by, "item", "rank")


def _weighted_median(pairs: Column) -> Column:
    """Lower weighted median of an array of (rank, weight) sorted by rank: the first rank at which at
    least half of the weight is reached."""
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["weight"])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))

    def step(a: Column, x: Column) -> Column:
        grown = a["sum"] + x["weight"]
        reached = a["at"].isNull() & (grown >= total / 2)
        return F.struct(grown.alias("sum"), F.when(reached, x["rank"].cast("double")).otherwise(a["at"]).alias("at"))

    return F.aggregate(pairs, start, step)["at"]


def median_ranks(scores: DataFrame, group: str, item: str, weights: dict[str, float], positions: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, item, median_rank, mean_rank, n_scores) for the score columns named in ``weights``; with
    ``positions`` also each item's ``position`` 1.. by median rank, mean rank and item."""
    score = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"s{k}") for k, c in enumerate(weights)]
    rows = scores.select(F.col(group).alias("g"), F.col(item).alias("item"), *score).where("item is not null")
    hot = _hot_groups(rows, hot_rows)
    if not hot:
        out = _by_windows(rows, list(weights.values()), positions)
    else:
        named = [g for g in hot if g is not None]
        is_hot = (F.coalesce(F.col("g").isin(named), F.lit(False)) if named else F.lit(False)) | (F.col("g").isNull() if None in hot else F.lit(False))
        hot_part = _hot(rows.where(is_hot & F.col("g").isNotNull()), weights, positions) if named else None
        if None in hot:  # joins know no null: the group is ranked under another name
            kind = F.col("g").cast(dict(rows.dtypes)["g"])
            nameless = _hot(rows.where("g is null").withColumn("g", F.lit("0").cast(dict(rows.dtypes)["g"])), weights, positions)
            nameless = nameless.withColumn("g", F.when(F.lit(False), kind))
            hot_part = nameless if hot_part is None else hot_part.unionByName(nameless)
        out = _by_windows(rows.where(~is_hot), list(weights.values()), positions).unionByName(hot_part)
    return out.withColumnsRenamed({"g": group, "item": item})


def _hot(rows: DataFrame, weights: dict[str, float], positions: bool) -> DataFrame:
    part = _by_buckets(rows, list(weights.values()))
    return _positions_by_buckets(part) if positions else part


def _hot_groups(rows: DataFrame, hot_rows: int) -> list:
    """Groups above the limit.  The limit grows with the table so that there are 10,000 at most."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    big = sizes.where(F.col("n") > hot_rows)  # the window below sees these only
    return [r.g for r in big.withColumn("total", total).where("n * 10000 > total").select("g").collect()]


def _by_windows(rows: DataFrame, weights: list[float], positions: bool) -> DataFrame:
    names = [f"s{k}" for k in range(len(weights))]
    once = rows.repartition("g").groupBy("g", "item").agg(*[F.max(n).alias(n) for n in names])
    group = Window.partitionBy("g")
    rank = [
        F.when(F.col(n).isNotNull(), F.rank().over(group.orderBy(F.desc_nulls_last(n)))).otherwise(F.count(n).over(group) + 1).cast("long").alias(f"r{k}")
        for k, n in enumerate(names)
    ]
    ranked = once.select("g", "item", sum(F.col(n).isNotNull().cast("long") for n in names).alias("n_scores"), *rank)
    pairs = F.array_sort(F.array(*[F.struct(F.col(f"r{k}").alias("rank"), F.lit(float(w)).alias("weight")) for k, w in enumerate(weights)]))
    mean = sum(F.col(f"r{k}") for k in range(len(weights))) / len(weights)
    out = ranked.select("g", "item", _weighted_median(pairs).alias("median_rank"), mean.alias("mean_rank"), "n_scores")
    return out.withColumn("position", F.row_number().over(group.orderBy("median_rank", "mean_rank", "item")).cast("long")) if positions else out


def _by_buckets(rows: DataFrame, weights: list[float]) -> DataFrame:
    names = [f"s{k}" for k in range(len(weights))]
    once = rows.groupBy("g", "item").agg(*[F.max(n).alias(n) for n in names])
    long = once.select("g", "item", F.posexplode(F.array(*names)).alias("signal", "score"))
    present = ranks(long, ["g", "signal"])
    counts = present.groupBy("g", "signal").agg(F.count("*").alias("present"))
    signals = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), F.lit(float(w)).alias("weight")) for k, w in enumerate(weights)]))
    all_of = once.select("g", "item", signals.alias("x")).select("g", "item", "x.signal", "x.weight")
    filled = (
        all_of.join(present, ["g", "signal", "item"], "left").join(counts, ["g", "signal"], "left")
        .select("g", "item", "weight", F.coalesce("rank", F.coalesce("present", F.lit(0)) + 1).alias("rank"), F.col("rank").isNotNull().alias("has"))
    )
    each = filled.groupBy("g", "item").agg(
        F.array_sort(F.collect_list(F.struct("rank", "weight"))).alias("pairs"),  # one entry per score
        F.avg("rank").alias("mean_rank"),
        F.sum(F.col("has").cast("long")).alias("n_scores"),
    )
    return each.select("g", "item", _weighted_median(F.col("pairs")).alias("median_rank"), "mean_rank", "n_scores")


def _positions_by_buckets(r: DataFrame) -> DataFrame:
    coarse = ranks(r.select("g", "item", (-F.col("median_rank")).alias("score")), ["g"])  # items of one median share a rank
    w = Window.partitionBy("g", "rank").orderBy("mean_rank", "item")
    return r.join(coarse, ["g", "item"]).select("g", "item", "median_rank", "mean_rank", "n_scores", (F.col("rank") - 1 + F.row_number().over(w)).alias("position"))


def first_of(ranked: DataFrame, group: str, item: str, all_scores: int) -> DataFrame:
    """The first item of each group that has all scores: one aggregate with map-side combine."""
    best = F.min(F.struct("median_rank", "mean_rank", F.col(item).alias("item"))).alias("m")
    return ranked.where(F.col("n_scores") == all_scores).groupBy(group).agg(best).select(group, F.col("m.item").alias(item))
