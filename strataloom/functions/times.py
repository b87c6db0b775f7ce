"""Epoch milliseconds as dates, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc(ms: str) -> Column:
    """The UTC wall-clock time of an epoch-millisecond column."""
    return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(`{ms}` AS DECIMAL(18, 3)) / 1000)")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (differences count, not the zone)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))
