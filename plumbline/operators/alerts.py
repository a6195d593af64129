"""Alerts as structs that detectors add to an array column, and the status that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import ALERT

ALERTS = f"array<{ALERT}>"
TYPES = (
    "DUPLICATE_EVENT", "LATE_EVENT", "SCHEMA_DRIFT", "NULL_SPIKE", "STALE_SOURCE", "ANOMALY_SPIKE", "FIELD_OUT_OF_RANGE",
    "FIELD_FORMAT_MISMATCH",
)


def alert(kind: str, severity: Column | str, message: Column, evidence: Column, field_path: Column | None = None) -> Column:
    """An alert of the row's source and event type; evidence is a struct or map."""
    return alert_of(kind, severity, message, F.to_json(evidence), field_path)


def alert_of(kind: str, severity: Column | str, message: Column, evidence_json: Column, field_path: Column | None = None) -> Column:
    """alert() whose evidence is JSON already."""
    severity = F.lit(severity) if isinstance(severity, str) else severity
    field_path = F.lit(None).cast("string") if field_path is None else field_path
    return F.struct(
        F.lit(kind).alias("alert_type"),
        severity.alias("severity"),
        F.col("source").alias("source"),
        F.col("event_type").alias("event_type"),
        field_path.alias("field_path"),
        message.alias("message"),
        evidence_json.alias("evidence_json"),
    ).cast(ALERT)


def no_alerts() -> Column:
    return F.array().cast(ALERTS)


def where(condition: Column, found: Column) -> Column:
    """An array with the alert where the condition holds, else an empty one."""
    return F.when(condition, F.array(found)).otherwise(no_alerts())


def add(df: DataFrame, *found: Column) -> DataFrame:
    """Append arrays of alerts to the alerts column."""
    held = F.col("alerts") if "alerts" in df.columns else no_alerts()
    return df.withColumn("alerts", F.concat(held, *found))


def quality_status(alerts: Column) -> Column:
    has = lambda kind: F.exists(alerts, lambda a: a["alert_type"] == kind)
    return (
        F.when(F.size(alerts) == 0, F.lit("OK"))
        .when(has("DUPLICATE_EVENT"), F.lit("DUPLICATE"))
        .when(has("LATE_EVENT"), F.lit("LATE"))
        .otherwise(F.lit("FLAGGED"))
    )


#: Places that an event's alerts may have; a payload would need as many fields.
PLACES = 1 << 20


def alert_id(seq: Column, place: Column) -> Column:
    """The id of an alert, from its event and its place there."""
    return F.when(place >= PLACES, F.raise_error(F.lit("too many alerts of one event"))).otherwise(seq * PLACES + place)


def exploded(processed: DataFrame) -> DataFrame:
    """One row for each alert of processed events: event columns, place in the event, alert columns, created_at."""
    # outer, as Spark else puts all detectors into a filter of the events with alerts and runs them twice
    rows = processed.select("seq", "event_id", F.col("received_at").alias("created_at"), F.posexplode_outer("alerts").alias("place", "alert"))
    return rows.where("alert IS NOT NULL").select("seq", "event_id", "place", "created_at", "alert.*")
