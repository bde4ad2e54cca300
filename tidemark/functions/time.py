"""Time expressions on wall-clock stamps (NTZ). The session time zone must be UTC, which ``prepare`` sets and
``Axis`` checks: then a stamp and its instant have the same number of microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds as a double, exact to the microsecond."""
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(1e6)


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket of ``seconds`` that holds ``ts``."""
    whole = epoch_seconds(ts)
    return F.timestamp_seconds(whole - F.pmod(whole, F.lit(seconds))).cast("timestamp_ntz")


def month(ts: Column) -> Column:
    """First instant of the month, as NTZ."""
    return F.trunc(ts, "month").cast("timestamp_ntz")


def hour_start(ts: Column) -> Column:
    return bucket(ts, 3600)


def day(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")
