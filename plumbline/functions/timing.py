"""Time arithmetic that is the same for TIMESTAMP and TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(time: Column) -> Column:
    """Microseconds from 1970 to the wall clock time of the session's zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, time.cast("timestamp_ntz"))


def to_micros(seconds: float) -> int:
    return round(seconds * MICROS)


def plus(time: Column, seconds: float) -> Column:
    return F.timestamp_add("MICROSECOND", F.lit(to_micros(seconds)), time)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, rounded down."""
    return F.floor((micros(end) - micros(start)) / MICROS).cast("long")


def window_start(time: Column, size: float) -> Column:
    """Start of the tumbling window, counted from 1970; size in seconds."""
    return F.timestamp_add("MICROSECOND", -F.pmod(micros(time), F.lit(to_micros(size))), time)


def iso_instant(time: Column) -> Column:
    """ISO-8601 text in UTC, with milliseconds or microseconds only where they are not zero."""
    at = micros(time)
    pattern = "yyyy-MM-dd'T'HH:mm:ss"
    text = (
        F.when(at % MICROS == 0, F.date_format(time, pattern))
        .when(at % 1000 == 0, F.date_format(time, pattern + ".SSS"))
        .otherwise(F.date_format(time, pattern + ".SSSSSS"))
    )
    return F.concat(text, F.lit("Z"))
