"""Freshness, health score and status of sources, and alerts when one goes stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import Settings, iso_duration
from plumbline.functions.timing import iso_instant, micros, plus, to_micros
from plumbline.operators.alerts import alert
from plumbline.operators.metrics import NULL_RATE


def stale_after(source: Column, event_type: Column, settings: Settings) -> Column:
    """Seconds after which a source counts as stale, by words in its name and type."""
    text = F.lower(F.concat_ws(" ", source, event_type))
    return (
        F.when(text.contains("rss") | text.contains("coindesk"), F.lit(float(settings.stale_after_rss)))
        .when(text.contains("document") | text.contains("pipeline") | text.contains("sourcehero"), F.lit(float(settings.stale_after_pipeline)))
        .otherwise(F.lit(float(settings.stale_after)))
    )


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.greatest(whole, F.lit(1)))


def score(duplicates: Column, late: Column, nulls: Column, alerts: Column, stale: Column) -> Column:
    """100 less capped penalties, between 0 and 100."""
    capped = lambda value, most: F.least(value, F.lit(float(most)))
    points = (
        F.lit(100.0)
        - capped(duplicates * 35.0, 35)
        - capped(late * 25.0, 25)
        - capped(nulls * 25.0, 25)
        - capped(alerts * 5.0, 20)
        - F.when(stale, F.lit(35.0)).otherwise(F.lit(0.0))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), points))


def status(points: Column, stale: Column) -> Column:
    return F.when(stale, F.lit("STALE")).when(points < 60, F.lit("UNHEALTHY")).otherwise(F.lit("HEALTHY"))


def latest_events(events: DataFrame) -> DataFrame:
    """(source, last_type, last_seen_at, seq): the event of each source with the latest time, of equals the last in seq."""
    last = events.groupBy("source").agg(F.max_by(F.struct("event_type", "event_timestamp", "seq"), F.struct("event_timestamp", "seq")).alias("l"))
    return last.select("source", F.col("l.event_type").alias("last_type"), F.col("l.event_timestamp").alias("last_seen_at"), "l.seq")


def rates(processed: DataFrame, now: Column, settings: Settings, latest: DataFrame | None = None) -> DataFrame:
    """By source: latest event, counts of the short and long look-back, duplicate and late rates; one pass over events.

    latest: latest_events() of all events, where processed holds those of the long look-back only.
    """
    after = lambda seconds: F.col("event_timestamp") > plus(now, -seconds)
    long_ = after(settings.long_look_back)
    sums = processed.groupBy("source").agg(
        F.max_by(F.struct("event_type", "event_timestamp"), F.struct("event_timestamp", "seq")).alias("l"),
        F.count_if(after(settings.short_look_back)).alias("events_last_5m"),
        F.count_if(long_).alias("events_last_1h"),
        F.count_if(long_ & (F.col("quality_status") == "DUPLICATE")).alias("duplicates"),
        F.count_if(long_ & (F.col("quality_status") == "LATE")).alias("lates"),
    )
    if latest is None:
        sums = sums.select("*", F.col("l.event_type").alias("last_type"), F.col("l.event_timestamp").alias("last_seen_at"))
    else:
        renamed = sums.withColumnRenamed("source", "of_source")
        sums = latest.join(renamed, F.col("source").eqNullSafe(F.col("of_source")), "left").fillna(0, ["events_last_5m", "events_last_1h", "duplicates", "lates"])
    return sums.select(
        "source",
        "last_type",
        "last_seen_at",
        "events_last_5m",
        "events_last_1h",
        rate(F.col("duplicates"), F.col("events_last_1h")).alias("duplicate_rate"),
        rate(F.col("lates"), F.col("events_last_1h")).alias("late_event_rate"),
    )


def null_rates(metrics: DataFrame, now: Column, settings: Settings) -> DataFrame:
    """(source, null_rate): the highest null rate of windows that end within the long look-back."""
    recent = metrics.where(F.col("metric_name").like(NULL_RATE + "%") & (F.col("window_end") > plus(now, -settings.long_look_back)))
    return recent.groupBy("source").agg(F.max("metric_value").alias("null_rate"))


def source_health(
    processed: DataFrame, alerts: DataFrame, metrics: DataFrame, now: Column, settings: Settings, latest: DataFrame | None = None
) -> DataFrame:
    """SOURCE_HEALTH rows, and last_type and stale_seconds. alerts: source and created_at; latest as in rates()."""
    recent = alerts.where(F.col("created_at") > plus(now, -settings.long_look_back)).groupBy("source").agg(F.count("*").alias("recent_alerts"))
    joined = rates(processed, now, settings, latest)
    for other in (null_rates(metrics, now, settings), recent):
        renamed = other.withColumnRenamed("source", "of_source")
        joined = joined.join(renamed, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    allowed = stale_after(F.col("source"), F.col("last_type"), settings)
    stale = micros(F.col("last_seen_at")) < micros(now) - (F.col("stale_seconds") * to_micros(1)).cast("long")
    joined = joined.withColumn("stale_seconds", allowed).withColumn("stale", stale)
    joined = joined.withColumn("null_rate", F.coalesce("null_rate", F.lit(0.0))).withColumn("recent_alerts", F.coalesce("recent_alerts", F.lit(0)))
    points = score(*[F.col(c) for c in ("duplicate_rate", "late_event_rate", "null_rate", "recent_alerts", "stale")])
    joined = joined.withColumn("health_score", points)
    return joined.select(
        "source", status(F.col("health_score"), F.col("stale")).alias("status"), "last_seen_at", "events_last_5m", "events_last_1h",
        "duplicate_rate", "late_event_rate", "null_rate", "health_score", now.alias("updated_at"), "last_type", "stale_seconds",
    )


def stale_alerts(health: DataFrame, previous: DataFrame | None, settings: Settings) -> DataFrame:
    """STALE_SOURCE alerts (created_at and alert columns) of sources that were not stale in the previous snapshot."""
    df = health.withColumn("event_type", F.col("last_type"))
    new = F.col("status") == "STALE"
    if previous is not None:
        before = previous.select(F.col("source").alias("of_source"), F.col("status").alias("status_before"))
        df = df.join(before, F.col("source").eqNullSafe(F.col("of_source")), "left")
        new &= F.coalesce(F.col("status_before") != "STALE", F.lit(True))
    names = {settings.stale_after: None, settings.stale_after_rss: None, settings.stale_after_pipeline: None}
    text = F.lit(None).cast("string")
    for seconds in names:
        text = F.when(F.col("stale_seconds") == float(seconds), F.lit(iso_duration(seconds))).otherwise(text)
    evidence = F.struct("source", iso_instant(F.col("last_seen_at")).alias("last_seen_at"), text.alias("stale_after"), "status", "health_score")
    message = F.concat(F.lit("Source "), F.col("source"), F.lit(" is stale; last event timestamp "), iso_instant(F.col("last_seen_at")))
    found = alert("STALE_SOURCE", "WARN", message, evidence)
    return df.where(new).select(F.col("updated_at").alias("created_at"), found.alias("a")).select("created_at", "a.*")
