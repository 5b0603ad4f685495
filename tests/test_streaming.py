"""Streams over several files: late rows are dropped, open windows are closed, empty streams give nothing."""

from datetime import datetime, timedelta

import pytest

from tarnwell.streaming import jobs

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
START = datetime(2024, 1, 1)


@pytest.fixture
def folder(spark, tmp_path):
    def write(*batches):
        path = str(tmp_path / "events.parquet")
        for k, hours in enumerate(batches):
            rows = [(100 * k + i, START + timedelta(hours=h), 1, "view", 1.0, None) for i, h in enumerate(hours)]
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        return str(tmp_path)

    return write


def test_all_windows_come_out(spark, folder):
    d = folder([0, 1, 7, 13])
    got = {(r.start.hour, r.n) for r in jobs.run_closed(spark, d, jobs.windowed_counts).collect()}
    assert got == {(0, 2), (6, 1), (12, 1)}
    assert {(r.start.hour, r.n) for r in jobs.run_closed(spark, d, jobs.sessions).collect()} == {(0, 2), (7, 1), (13, 1)}
    assert sum(r.n for r in jobs.run_closed(spark, d, jobs.sliding_counts).collect()) == 12


def test_late_rows_are_dropped(spark, folder):
    """A row of a window that the watermark has passed takes no part; one within the hour does."""
    d = folder([0, 7.5], [7.0], [30], [1])
    got = {(r.start.day, r.start.hour, r.n) for r in jobs.run_closed(spark, d, jobs.windowed_counts, files_per_trigger=1).collect()}
    assert got == {(1, 0, 1), (1, 6, 2), (2, 6, 1)}


def test_empty_stream(spark, folder):
    assert jobs.run_closed(spark, folder([]), jobs.windowed_counts).count() == 0
