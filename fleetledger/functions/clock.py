"""Age tests at whole-second grain, written so that they reach the scan.

An age is ``seconds(now) - seconds(ts)`` with both sides cut to whole seconds.
The tests below compare the bare column with a constant, which is the same
condition and can be pushed down to Parquet.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(now: str | datetime | Column) -> Column:
    """``now`` as a timestamp column."""
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def age_seconds(ts: Column, now) -> Column:
    return F.unix_timestamp(instant(now)) - F.unix_timestamp(ts)


def is_fresh(ts: Column, now, timeout: int) -> Column:
    """Age strictly below ``timeout``."""
    return ts >= F.timestamp_seconds(F.unix_timestamp(instant(now)) - timeout + 1)


def is_stale(ts: Column, now, timeout: int) -> Column:
    """Age strictly above ``timeout``; an age equal to it is neither fresh nor stale."""
    return ts < F.timestamp_seconds(F.unix_timestamp(instant(now)) - timeout)


def is_past_days(ts: Column, now, days: int) -> Column:
    """More than ``days`` completed 24-hour periods old."""
    return ts <= instant(now) - F.make_dt_interval(F.lit(days + 1))
