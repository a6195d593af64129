"""Schemas of the input envelope and of the result tables."""

from __future__ import annotations

EVENT = "event_id string, source string, event_type string, event_timestamp timestamp, payload string"
#: What a batch adds: the order of arrival, and when each event came.
ARRIVAL = "seq long, received_at timestamp"
ALERT = "struct<alert_type:string,severity:string,source:string,event_type:string,field_path:string,message:string,evidence_json:string>"

RAW_EVENTS = (
    "id long, event_id string, source string, event_type string, event_timestamp timestamp, received_at timestamp, "
    "payload_json string, payload_hash string, quality_status string"
)
QUALITY_ALERTS = (
    "id long, alert_type string, severity string, source string, event_type string, field_path string, message string, "
    "evidence_json string, created_at timestamp, resolved_at timestamp, status string, acknowledged_by string, "
    "acknowledged_at timestamp, root_cause string, incident_id long"
)
SCHEMA_VERSIONS = (
    "event_type string, schema_hash string, schema_json string, first_seen_at timestamp, last_seen_at timestamp, status string"
)
METRIC_WINDOWS = (
    "source string, event_type string, window_start timestamp, window_end timestamp, metric_name string, metric_value double"
)
SOURCE_HEALTH = (
    "source string, status string, last_seen_at timestamp, events_last_5m long, events_last_1h long, duplicate_rate double, "
    "late_event_rate double, null_rate double, health_score double, updated_at timestamp"
)
ALERT_INCIDENTS = (
    "id long, title string, description string, status string, source string, event_type string, created_at timestamp, resolved_at timestamp"
)
REJECTED_EVENTS = f"{EVENT}, received_at timestamp, violations string"
#: What the detectors remember from batch to batch.
BASELINES = "baseline_type string, baseline_hash string, baseline array<struct<path:string,type:string>>"
NULL_RUNS = "source string, event_type string, window_start timestamp, total long, nulls array<struct<field_path:string,n:bigint>>"
LATEST_EVENTS = "source string, last_type string, last_seen_at timestamp, seq long"
#: One row for each batch: the numbers of arrival that it used, its size, and the times that its rows cover.
BATCHES = (
    "batch int, numbers long, events_ingested long, alerts_fired long, first_received timestamp, last_received timestamp, first_event timestamp, last_event timestamp"
)
