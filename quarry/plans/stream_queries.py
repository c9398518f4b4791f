"""Queries that read tables as streams."""

from __future__ import annotations

from quarry.session import load
from quarry.streaming.counts import read_stream, run_once, windowed_counts


def _stream(spark, sf_dir, table):
    return read_stream(spark, sf_dir, table, load(spark, sf_dir, table).schema)


def event_windows(spark, sf_dir):
    return run_once(windowed_counts(_stream(spark, sf_dir, "events"), "ts", "event_type"))


QUERIES = {"event_windows": event_windows}
SQL = {"event_windows": "select date_trunc('hour', ts) as window_start, event_type, count(*)::bigint as n from events group by 1, 2"}
