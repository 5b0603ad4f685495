"""Streaming jobs: windowed counts, sliding windows, sessions and first facts per user, with watermarks.

Each job maps a streaming DataFrame to a streaming DataFrame; ``run_to_end`` runs one over what is there
(``availableNow``) into parquet in the shared checkpoint folder and reads the result back.  ``run_closed``
does so for jobs with a watermark: when all is read, one more row, long after all others, closes the
windows that are still open, so that none is lost.  The batch twin of each job is the same function over a
batch DataFrame where Spark allows it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnwell.runtime import ensure_checkpoint_dir
from tarnwell.sources import table


def events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 4) -> DataFrame:
    """The event table, one file or a folder of them, as a stream of files, with ``ts`` as a timestamp in UTC."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(e: DataFrame, length: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts and sums per tumbling window and type; events later than ``late`` are dropped."""
    w = e.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(e: DataFrame, length: str = "6 hours", slide: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Counts per sliding window and type: an event counts in each window that holds it."""
    w = e.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "event_type")
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(e: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Sessions per user: events less than ``gap`` apart."""
    s = e.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_facts(e: DataFrame) -> DataFrame:
    """The first event of each type per user, kept as state and sent once."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set((state.get[0] or "").split(",")) if state.exists else set()
        rows = []
        for pdf in pdfs:
            for t, i, v in pdf.sort_values(["ts", "event_id"])[["event_type", "event_id", "value"]].itertuples(index=False):
                if t not in seen:
                    seen.add(t)
                    rows.append((key[0], t, i, v))
        state.update((",".join(sorted(seen - {""})),))
        yield pd.DataFrame(rows, columns=["user_id", "event_type", "event_id", "value"])

    schema = "user_id bigint, event_type string, event_id bigint, value double"
    return e.groupBy("user_id").applyInPandasWithState(step, schema, "seen string", "append", GroupStateTimeout.NoTimeout)


def _home(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _run(stream: DataFrame, home: str, mode: str = "append") -> None:
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{home}/state").option("path", f"{home}/out").trigger(availableNow=True).start()
    q.awaitTermination()


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and give its result as a batch DataFrame."""
    spark = stream.sparkSession
    home = _home(spark)
    _run(stream, home, mode)
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def run_closed(spark: SparkSession, sf_dir: str, job: Callable[[DataFrame], DataFrame], files_per_trigger: int = 4) -> DataFrame:
    """Run a job with a watermark over all events, then close what is still open.

    The job reads the events and a folder of closing rows as one stream.  The folder is empty in the first
    run; then one row of a time ten years after the last event goes there, and the job goes on from its
    checkpoint.  The row's own window never closes, so it isn't in the result."""
    home = _home(spark)
    still = table(spark, sf_dir, "events")
    closing = f"{home}/closing"
    still.limit(0).write.mode("append").parquet(closing)

    def both() -> DataFrame:
        end = spark.readStream.schema(still.schema).parquet(closing).withColumn("ts", F.col("ts").cast("timestamp"))
        return job(events(spark, sf_dir, files_per_trigger).unionByName(end))

    _run(both(), home)
    last = still.agg(F.max("ts").alias("ts")).where("ts is not null")
    kinds = dict(still.dtypes)
    row = last.select(*[(F.col("ts") + F.expr("interval 10 years") if c == "ts" else F.lit(None)).cast(kinds[c]).alias(c) for c in still.columns])
    row.write.mode("append").parquet(closing)
    _run(both(), home)
    return spark.read.schema(both().schema).parquet(f"{home}/out")
