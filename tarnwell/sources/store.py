"""Tables built once per application and read by many queries: indexes and runs.

They are written below the shared checkpoint folder, under a name that tells the application, the table
and the files that it was built from, so other inputs give another table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwell.runtime import ensure_checkpoint_dir

_written: dict[str, DataFrame] = {}


def stored(spark: SparkSession, name: str, inputs: list[DataFrame], build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """The table ``name`` of ``inputs``: built and written at first use, sorted by ``by`` so that readers
    skip what they don't ask for; read from then on.  A stage that is there is not run again."""
    files = sorted(f for df in inputs for f in df.inputFiles())
    key = hashlib.sha256("\n".join([spark.sparkContext.applicationId, name, *files]).encode()).hexdigest()[:24]
    if key not in _written:
        path = f"{ensure_checkpoint_dir(spark)}/{name}-{key}"
        made = build()
        if by:
            made = made.repartitionByRange(by).sortWithinPartitions(by)
        made.write.mode("overwrite").parquet(path)
        _written[key] = spark.read.schema(made.schema).parquet(path)
    return _written[key]
