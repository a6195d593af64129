"""Checks that need one event only: lateness, ranges and formats of fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.config import Bounds, Settings, iso_duration
from plumbline.functions.payload import token, variant
from plumbline.functions.timing import iso_instant, micros, seconds_between, to_micros
from plumbline.operators.alerts import alert, where


def lateness_severity(event_time: Column, received: Column, threshold: float) -> Column:
    """WARN beyond ten thresholds, INFO beyond one, else null."""
    late = micros(received) - micros(event_time)
    return F.when(late > to_micros(10 * threshold), F.lit("WARN")).when(late > to_micros(threshold), F.lit("INFO"))


def late_event(settings: Settings) -> Column:
    """Alerts of events that arrive later than the threshold after their time."""
    event_time, received = F.col("event_timestamp"), F.col("received_at")
    threshold = iso_duration(settings.late_threshold)
    severity = lateness_severity(event_time, received, settings.late_threshold)
    late = seconds_between(event_time, received)
    evidence = F.struct(
        iso_instant(event_time).alias("event_timestamp"),
        iso_instant(received).alias("received_at"),
        late.alias("lateness_seconds"),
        F.lit(threshold).alias("threshold"),
    )
    message = F.concat(F.lit("Event arrived "), late.cast("string"), F.lit(f"s after event_timestamp (threshold {threshold})"))
    return where(severity.isNotNull(), alert("LATE_EVENT", severity, message, evidence))


def out_of_range(value: Column, bounds: Bounds) -> Column:
    """Whether a number lies outside of the bounds; false for null."""
    low = F.lit(False) if bounds.low is None else value < bounds.low
    high = F.lit(False) if bounds.high is None else value > bounds.high
    return F.coalesce(low | high, F.lit(False))


def _range_reason(value: Column, bounds: Bounds) -> Column:
    text = value.cast("string")
    low, high = (None if b is None else str(float(b)) for b in (bounds.low, bounds.high))
    if bounds.high is None:
        return F.concat(text, F.lit(f" < {low}"))
    if bounds.low is None:
        return F.concat(text, F.lit(f" > {high}"))
    return F.concat(text, F.lit(f" outside [{low}, {high}]"))


def _field(name: str) -> Column:
    """A top-level field of the payload as a variant; null if it is missing."""
    return F.try_element_at(F.try_variant_get(variant(F.col("payload")), "$", "map<string,variant>"), F.lit(name))


def field_ranges(settings: Settings) -> list[Column]:
    """For each configured top-level field, alerts of numbers outside of its bounds."""
    found = []
    for name, bounds in settings.ranges.items():
        field = _field(name)
        value = F.try_variant_get(field, "$", "double")  # of text too: whether it is a number is looked at where it lies outside
        number = lambda b: F.lit(None if b is None else float(b)).cast("double")
        evidence = F.struct(
            F.lit(name).alias("field_path"), value.alias("value"), number(bounds.low).alias("min"), number(bounds.high).alias("max")
        )
        message = F.concat(F.lit(f"Field {name} out of range in "), F.col("event_type"), F.lit(" ("), _range_reason(value, bounds), F.lit(")"))
        found.append(where(out_of_range(value, bounds) & (token(field) == "NUMBER"), alert("FIELD_OUT_OF_RANGE", "WARN", message, evidence, F.lit(name))))
    return found


def matches_whole(value: Column, pattern: str) -> Column:
    """Whether the whole of a string matches."""
    return value.rlike(rf"\A(?:{pattern})\z")


def field_formats(settings: Settings) -> list[Column]:
    """For each configured top-level field, alerts of values that are no strings or do not match as a whole."""
    found = []
    for name, pattern in settings.formats.items():
        field = _field(name)
        kind = token(field)
        text = F.when(kind == "STRING", F.try_variant_get(field, "$", "string"))
        other = field.isNotNull() & ~kind.isin("NULL", "STRING")
        wrong = F.coalesce(~matches_whole(text, pattern), F.lit(False))
        evidence = F.struct(
            F.lit(name).alias("field_path"),
            F.when(other, F.lit("NOT_A_STRING")).otherwise(F.lit("PATTERN_MISMATCH")).alias("reason"),
            F.when(other, kind).alias("value_type"),
            text.alias("value"),
            F.when(~other, F.lit(pattern)).alias("pattern"),
        )
        rest = F.when(other, F.lit(" is not a string in ")).otherwise(F.lit(" does not match expected format in "))
        message = F.concat(F.lit(f"Field {name}"), rest, F.col("event_type"))
        found.append(where(other | wrong, alert("FIELD_FORMAT_MISMATCH", "WARN", message, evidence, F.lit(name))))
    return found
