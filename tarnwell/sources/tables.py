"""Sources and sinks of the engine.

JSON readers take an explicit schema and fail on malformed rows: inference would turn maps into wide
structs and would cost a pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``, pruned to ``columns`` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that hold one JSON array (or object) each, possibly over many lines."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls left out."""
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON-lines file; for aggregates, not for tables that grow."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_index(df: DataFrame, path: str, experiment: bool = False) -> None:
    """An index table; an experiment never replaces one that is there."""
    df.write.mode("errorifexists" if experiment else "overwrite").parquet(path)


def latest_by_key(df: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Append-only log to current state: the last non-empty value of a key wins, an empty one only if
    there is no other.  One aggregate with map-side combine, so a hot key costs no sort."""
    filled = F.when(F.length(F.trim(F.col(value))) > 0, 1).otherwise(0)
    return df.groupBy(key).agg(F.max(F.struct(filled.alias("f"), F.col(seq).alias("s"), F.col(value).alias("v"))).alias("m")).select(
        key, F.col("m.s").alias(seq), F.col("m.v").alias(value)
    )
