"""Relational operators that the SQL surface lacks or that need care at scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof(left: DataFrame, right: DataFrame, by: str, at: str, value: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time.

    One union and one window instead of a range join: the pairs of a key are never formed."""
    tag = F.struct(F.col(at).alias("_at"), *value)
    l = left.select("*", F.lit(None).cast(right.select(tag.alias("t")).schema["t"].dataType).alias("_r"), F.lit(1).alias("_side"))  # noqa: E741
    blank = [F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c not in (by, at)]
    r = right.select(by, at, *blank, tag.alias("_r"), F.lit(0).alias("_side")).select(*l.columns)
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_m", F.last("_r", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*left.columns, *[F.col(f"_m.{v}").alias(v) for v in value])


def range_join(points: DataFrame, bands: DataFrame, at: str, lo: str, hi: str, width: float) -> DataFrame:
    """Points inside bands [lo, hi] by cells of ``width``: an equi-join on cells with a filter, not a
    nested loop.  A band covers (hi - lo) / width + 1 cells."""
    cell = F.floor(F.col(at) / width)
    cells = F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    return points.withColumn("_c", cell).join(bands.withColumn("_c", cells), "_c").where(F.col(at).between(F.col(lo), F.col(hi))).drop("_c")


def salted_sum(df: DataFrame, key: str, value: Column, salts: int = 16) -> DataFrame:
    """Sum per key in two steps, so that a key that holds a third of the rows is spread."""
    part = df.select(key, value.alias("v"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("s"))
    return part.groupBy(key, "s").agg(F.sum("v").alias("v")).groupBy(key).agg(F.sum("v").alias("total"))
