"""Shared inputs of the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnwell.sources import table

PAGES, EVIDENCE, QUESTIONS = "page_record", "pregnancy_scope_evidence_pack", "question_sample2"
#: where each source keeps its key and its text
FIELDS = {PAGES: ("row_id", "text"), EVIDENCE: ("ev_id", "raw_text"), QUESTIONS: ("sample_id", "text")}

#: a word: a maximal run of letters and digits
WORD = re.compile(r"[^\W_]+")


def items(spark: SparkSession, sf_dir: str, *sources: str) -> DataFrame:
    """(src, id, text) of whole tables; null texts stay."""
    out = None
    for src in sources:
        key, col = FIELDS[src]
        one = table(spark, sf_dir, src).select(F.lit(src).alias("src"), F.col(key).alias("id"), F.col(col).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def slices(batch: pa.RecordBatch, columns: list[int], rows: int = 1000, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and about ``size`` bytes of text (or list entries) in
    ``columns``, so that a run of very long texts doesn't meet in one slice.  A row is never cut."""
    total = np.zeros(batch.num_rows, dtype=np.int64)
    for c in columns:
        column = batch.column(c)
        measure = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
        total += np.asarray(pc.fill_null(measure(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    ends = np.cumsum(total)
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = int(np.searchsorted(ends, before + size, side="right"))
        stop = min(max(stop, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop
