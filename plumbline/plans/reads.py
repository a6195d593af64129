"""The read queries over the result tables: lists, searches, points, statistics and the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.timing import plus

DAY = 86_400.0


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number` (from 0) of a sorted frame."""
    return df.offset(number * size).limit(size) if number else df.limit(size)


def recent_events(events: DataFrame, number: int = 0, size: int = 20) -> DataFrame:
    """Newest first; of equal times the last id first."""
    return page(events.orderBy(F.desc("received_at"), F.desc("seq")), number, size)


def alerts_filtered(
    alerts: DataFrame, *, status: str | None = None, kind: str | None = None, source: str | None = None
) -> DataFrame:
    """By status alone if it is given and not blank, else by type and source where they are given."""
    if status and status.strip():
        return alerts.where(F.col("status") == status)
    if kind is not None:
        alerts = alerts.where(F.col("alert_type") == kind)
    return alerts if source is None else alerts.where(F.col("source") == source)


def alerts_list(alerts: DataFrame, number: int = 0, size: int = 50, **filters) -> DataFrame:
    return page(alerts_filtered(alerts, **filters).orderBy(F.desc("created_at"), F.desc("id")), number, size)


def schema_list(versions: DataFrame, event_type: str | None = None) -> DataFrame:
    rows = versions if event_type is None else versions.where(F.col("event_type") == event_type)
    return rows.orderBy("event_type", "first_seen_at", "schema_hash")


def metric_search(
    metrics: DataFrame,
    *,
    source: str | None = None,
    event_type: str | None = None,
    metric_name: str | None = None,
    number: int = 0,
    size: int = 100,
) -> DataFrame:
    """Metric windows by any of three names, newest window first."""
    for column, value in (("source", source), ("event_type", event_type), ("metric_name", metric_name)):
        if value is not None:
            metrics = metrics.where(F.col(column) == value)
    return page(metrics.orderBy(F.desc("window_start"), "metric_name", "source", "event_type"), number, size)


def health_list(health: DataFrame) -> DataFrame:
    return health.orderBy("health_score", "source")


def incidents_list(incidents: DataFrame, status: str | None = None) -> DataFrame:
    rows = incidents if status is None else incidents.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "source", "event_type")


def by_key(table: DataFrame, column: str, value) -> DataFrame:
    """The row with a key; no row where there is none."""
    return table.where(F.col(column) == value)


def distinct_sources(events: DataFrame) -> DataFrame:
    return events.select("source").distinct().orderBy("source")


def schema_summary(versions: DataFrame) -> DataFrame:
    """By event type: versions, drifting ones and the hash of the active one."""
    return versions.groupBy("event_type").agg(
        F.count("*").alias("versions"),
        F.count_if(F.col("status") == "DRIFTING").alias("drifting"),
        F.max(F.when(F.col("status") == "ACTIVE", F.col("schema_hash"))).alias("active_hash"),
    )


def dashboard_summary(events: DataFrame, alerts: DataFrame, health: DataFrame, now: Column) -> DataFrame:
    """One row: total_events, active_sources, alerts_last_24h, unhealthy_sources."""
    totals = events.agg(F.count("*").alias("total_events"), F.count_distinct("source").alias("active_sources"))
    recent = alerts.agg(F.count_if(F.col("created_at") > plus(now, -DAY)).alias("alerts_last_24h"))
    unhealthy = health.agg(F.count_if(F.col("status").isin("UNHEALTHY", "STALE")).alias("unhealthy_sources"))
    one = lambda df: df.withColumn("__one", F.lit(1))  # noqa: E731  each side is a single row
    return one(totals).join(one(recent), "__one").join(one(unhealthy), "__one").drop("__one")


def percent(value: Column) -> Column:
    return F.concat(F.format_number(value * 100, 1), F.lit("%"))


def short_hash(value: Column) -> Column:
    return F.substring(value, 1, 12)


#: Columns of what a client is shown of each table; alerts without their incident.
RESPONSES = {
    "raw_events": "id event_id source event_type event_timestamp received_at payload_json payload_hash quality_status".split(),
    "quality_alerts": "id alert_type severity source event_type field_path message evidence_json created_at resolved_at status acknowledged_by acknowledged_at root_cause".split(),
    "schema_versions": "event_type schema_hash schema_json first_seen_at last_seen_at status".split(),
    "metric_windows": "source event_type window_start window_end metric_name metric_value".split(),
    "source_health": "source status last_seen_at events_last_5m events_last_1h duplicate_rate late_event_rate null_rate health_score updated_at".split(),
    "alert_incidents": "id title description status source event_type created_at resolved_at".split(),
}


def response(rows: DataFrame, table: str) -> DataFrame:
    return rows.select(*RESPONSES[table])
