"""Readers and writers: parquet tables of a folder, JSON lines, JSON arrays, latest-by-key logs."""

from tarnwell.sources.tables import (  # noqa: F401
    latest_by_key,
    read_json_array,
    read_jsonl,
    table,
    write_index,
    write_jsonl,
    write_report,
)
