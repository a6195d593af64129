"""The event envelope: validation, enrichment and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.payload import allow_repeated_keys, payload_hash

_TEXTS = ("event_id", "source", "event_type")


def violations() -> Column:
    """array<string> 'field: message' of an event, empty if it is valid."""
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")), F.lit("")) == ""
    checks = [(blank(c), f"{c}: must not be blank") for c in _TEXTS]
    checks += [(F.col(c).isNull(), f"{c}: must not be null") for c in ("event_timestamp", "payload")]
    return F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]), lambda m: m.isNotNull())


def validate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejected events with their violations joined by '; ')."""
    checked = events.withColumn("violations", violations())
    valid = checked.where(F.size("violations") == 0).drop("violations")
    rejected = checked.where(F.size("violations") > 0).withColumn("violations", F.array_join("violations", "; "))
    return valid, rejected


def enrich(events: DataFrame) -> DataFrame:
    """Add payload_hash, and received_at as the time now where events do not bring it; payloads may repeat keys.

    Events of a table that have seq are dealt out by it before payloads are parsed: their source may be a few large files.
    """
    allow_repeated_keys(events.sparkSession)
    if "seq" in events.columns and not events.isStreaming:
        events = events.repartition("seq")
    if "received_at" not in events.columns:
        events = events.withColumn("received_at", F.current_timestamp())
    return events.withColumn("payload_hash", payload_hash(F.col("payload")))


def partition_key() -> Column:
    return F.concat_ws("|", "source", "event_type")
