"""Metrics of tumbling windows in long format."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import Settings
from plumbline.functions.timing import plus, to_micros, window_start
from plumbline.operators.spikes import window_counts

NULL_RATE = "NULL_RATE:"


def event_counts(events: DataFrame, settings: Settings) -> DataFrame:
    """EVENT_COUNT of each source, type and window."""
    counts = window_counts(events, settings.window_size)
    return _long(counts, F.lit("EVENT_COUNT"), F.col("events").cast("double"), settings)


def null_metrics(observed: DataFrame, settings: Settings) -> DataFrame:
    """NULL_TOTAL:field, NULL_COUNT:field and NULL_RATE:field of each source, type and window, for the fields of the type's baseline."""
    return _three(window_sums(observed, settings).where("field_path IS NOT NULL"), settings)


def _three(sums: DataFrame, settings: Settings) -> DataFrame:
    """NULL_TOTAL, NULL_COUNT and NULL_RATE from (source, event_type, window_start, field_path, total, nulls)."""
    three = F.stack(
        F.lit(3),
        F.lit("NULL_TOTAL:"), F.col("total"),
        F.lit("NULL_COUNT:"), F.col("nulls"),
        F.lit(NULL_RATE), F.col("nulls") / F.col("total"),
    )
    rows = sums.select("source", "event_type", "window_start", "field_path", three.alias("prefix", "value"))
    return _long(rows, F.concat("prefix", "field_path"), F.col("value"), settings)


def window_sums(observed: DataFrame, settings: Settings) -> DataFrame:
    """(source, event_type, window_start, field_path, total, nulls); a row without a field counts the events of the window.

    Needs the columns of schemas.with_baseline(). Events are counted by their fields and those that are null, which are
    few for a type; fields are spread afterwards.
    """
    keys = ["source", "event_type", window_start(F.col("event_timestamp"), settings.window_size).alias("window_start")]
    return _of_fields(observed.groupBy(*keys, "leaves", "empty").agg(F.count("*").alias("events")), "window_start")


def streamed_sums(shaped: DataFrame, settings: Settings, watermark: str, walked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """window_sums() of a stream in append mode: each window comes once, when no event within the delay of the watermark
    ("1 hour") can belong to it any more; later ones are left out.

    shaped: events with __shape; walked adds the columns of schemas.with_baseline() to rows with event_type and __shape.
    Events are counted by shape, so that a shape is walked through once a window and not for each event.
    """
    rows = shaped.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp")).withWatermark("event_timestamp", watermark)
    span = F.window("event_timestamp", f"{to_micros(settings.window_size)} microseconds")
    counts = rows.groupBy(span.alias("w"), "source", "event_type", "__shape").agg(F.count("*").alias("events"))
    sums = _of_fields(walked(counts), "w")
    return sums.select("source", "event_type", F.col("w.start").alias("window_start"), "field_path", "total", "nulls")


def _of_fields(counts: DataFrame, window: str) -> DataFrame:
    """Sums of (source, event_type, window, events, leaves, empty) by field, and those of all events, without a field."""
    none = F.array(F.lit(None).cast("string"))
    fields = F.when(F.col("leaves").isNull(), none).otherwise(F.concat(none, "leaves"))
    rows = counts.select(window, "source", "event_type", "events", "empty", F.explode(fields).alias("field_path"))
    null = F.when(F.array_contains("empty", F.col("field_path")), F.col("events")).otherwise(F.lit(0))
    sums = [F.sum("events").cast("double").alias("total"), F.sum(null).cast("double").alias("nulls")]
    return rows.groupBy("source", "event_type", window, "field_path").agg(*sums)


def from_sums(sums: DataFrame, settings: Settings) -> DataFrame:
    """metric_windows() from window_sums()."""
    counts = _long(sums.where("field_path IS NULL"), F.lit("EVENT_COUNT"), F.col("total"), settings)
    return counts.unionByName(_three(sums.where("field_path IS NOT NULL"), settings))


def settled(final: DataFrame, sums: DataFrame) -> DataFrame:
    """window_sums() with status: FINAL as the stream gave them, and what they lack of all events: LATE where the window
    was final already, else OPEN."""
    own = ["source", "event_type", "window_start", "field_path"]
    done = final.select(*[F.col(c).alias(f"of_{c}") for c in own], F.col("total").alias("t"), F.col("nulls").alias("n"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in own])
    rest = sums.join(done, same, "left").select(
        *own, (F.col("total") - F.coalesce("t", F.lit(0.0))).alias("total"), (F.col("nulls") - F.coalesce("n", F.lit(0.0))).alias("nulls"),
        F.when(F.col("t").isNull(), F.lit("OPEN")).otherwise(F.lit("LATE")).alias("status"),
    )
    return final.select(*own, "total", "nulls", F.lit("FINAL").alias("status")).unionByName(rest.where("total > 0"))


def merged(rows: DataFrame, settings: Settings) -> DataFrame:
    """metric_windows() of several batches as one table: counts add up, and rates follow from them."""
    name, value = F.col("metric_name"), F.col("metric_value")
    keys = ["source", "event_type", "window_start"]
    events = rows.where(name == "EVENT_COUNT").groupBy(*keys).agg(F.sum("metric_value").alias("events"))
    counts = _long(events, F.lit("EVENT_COUNT"), F.col("events"), settings)
    parts = rows.where(name.startswith("NULL_TOTAL:") | name.startswith("NULL_COUNT:"))
    field = F.substring(name, F.lit(12), F.length(name))
    total = F.sum(F.when(name.startswith("NULL_TOTAL:"), value).otherwise(F.lit(0.0)))
    nulls = F.sum(F.when(name.startswith("NULL_COUNT:"), value).otherwise(F.lit(0.0)))
    sums = parts.groupBy(*keys, field.alias("field_path")).agg(total.alias("total"), nulls.alias("nulls"))
    return counts.unionByName(_three(sums, settings))


def _long(rows: DataFrame, name: Column, value: Column, settings: Settings) -> DataFrame:
    return rows.select(
        "source", "event_type", "window_start", plus(F.col("window_start"), settings.window_size).alias("window_end"),
        name.alias("metric_name"), value.alias("metric_value"),
    )


def metric_windows(observed: DataFrame, settings: Settings) -> DataFrame:
    """All metrics; needs the columns of schemas.with_baseline()."""
    return from_sums(window_sums(observed, settings), settings)


def recent_windows(metrics: DataFrame, source: str, event_type: str, metric_name: str, before: Column, n: int) -> DataFrame:
    """The last n completed windows of a metric: those that end at `before` or earlier, newest first."""
    if n < 1:
        raise ValueError("n must be at least 1")
    own = (F.col("source") == source) & (F.col("event_type") == event_type) & (F.col("metric_name") == metric_name)
    return metrics.where(own & (F.col("window_end") <= before)).orderBy(F.desc("window_start")).limit(n)
