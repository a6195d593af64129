"""Schema versions of payloads, and drift from the first schema of an event type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import payload as P
from plumbline.operators.alerts import add, alert_of, where
from plumbline.sources.store import stored


def walked(shapes: DataFrame) -> DataFrame:
    """Add schema (sorted entries) and schema_hash of __shape."""
    # step by step, so that each shape is walked through once
    df = shapes.withColumn("__entries", P.raw_entries(F.col("__shape"))).withColumn("schema", P.sorted_entries(F.col("__entries"))).drop("__entries")
    return df.withColumn("schema_hash", P.schema_hash(F.col("schema")))


def shaped(events: DataFrame) -> DataFrame:
    """Add __shape, that of the payload; payloads are parsed for it once."""
    return events.withColumn("__shape", P.shape(F.col("payload")))


@dataclass(frozen=True)
class Described:
    """Events with the shape of their payloads (__shape), stored; and kinds, a row for each type and shape.

    kinds: event_type, __shape, schema, schema_hash, first (struct of received_at and seq), last_seen_at, first_event_at
    and last_event_at. What follows from a type and a shape is reckoned for its kind, not for each event.
    """

    events: DataFrame
    kinds: DataFrame

    def joined(self, kinds: DataFrame, *wanted: str) -> DataFrame:
        """The events with columns of their kind; whether kinds are broadcast is left to their measured size."""
        of = kinds.select(F.col("event_type").alias("__type_of"), F.col("__shape").alias("__shape_of"), *wanted)
        same = F.col("event_type").eqNullSafe(F.col("__type_of")) & (F.col("__shape") == F.col("__shape_of"))
        return self.events.join(of, same).drop("__shape", "__type_of", "__shape_of")

    def with_baseline(self, known: DataFrame | None = None) -> DataFrame:
        """with_baseline() of the events; known: baselines that hold already, by default those of these events."""
        found = baselines(self.kinds) if known is None else known
        return self.joined(stored(with_baseline(self.kinds, found)), "schema", "schema_hash", *OF_BASELINE)


def describe(events: DataFrame) -> Described:
    """Parse payloads once, for their shape, which is stored with the events, and walk through each shape once a type."""
    held = stored(shaped(events))
    times = [F.min("event_timestamp").alias("first_event_at"), F.max("event_timestamp").alias("last_event_at")]
    kinds = held.groupBy("event_type", "__shape").agg(F.min(_arrival()).alias("first"), F.max("received_at").alias("last_seen_at"), *times)
    return Described(held, stored(walked(kinds)))


def observe(events: DataFrame) -> DataFrame:
    """Add schema (sorted entries) and schema_hash of the payload; see describe().

    On a stream, where nothing can be stored, each payload is walked through.
    """
    if events.isStreaming:
        return walked(shaped(events)).drop("__shape")
    found = describe(events)
    return found.joined(found.kinds, "schema", "schema_hash")


def _arrival() -> Column:
    return F.struct("received_at", "seq")


def _first(observed: DataFrame) -> Column:
    return F.col("first") if "first" in observed.columns else _arrival()


def versions(observed: DataFrame) -> DataFrame:
    """event_type, schema_hash, schema_json, first_seen_at, last_seen_at, status; the first of a type is ACTIVE.

    observed: events of observe(), or the kinds of describe().
    """
    by_hash = observed.groupBy("event_type", "schema_hash").agg(
        F.any_value("schema").alias("schema"),
        F.min(_first(observed)).alias("first"),
        F.max("last_seen_at" if "last_seen_at" in observed.columns else "received_at").alias("last_seen_at"),
    )
    active = by_hash.groupBy(F.col("event_type").alias("of_type")).agg(F.min_by("schema_hash", "first").alias("active_hash"))
    joined = by_hash.join(active, F.col("event_type").eqNullSafe(F.col("of_type")))
    return joined.select(
        "event_type",
        "schema_hash",
        P.schema_json(F.col("schema")).alias("schema_json"),
        F.col("first.received_at").alias("first_seen_at"),
        "last_seen_at",
        F.when(F.col("schema_hash") == F.col("active_hash"), F.lit("ACTIVE")).otherwise(F.lit("DRIFTING")).alias("status"),
    )


def baselines(observed: DataFrame) -> DataFrame:
    """(baseline_type, baseline_hash, baseline): the first schema of each event type; a row for each type.

    observed: events of observe(), or the kinds of describe().
    """
    first = observed.groupBy(F.col("event_type").alias("baseline_type")).agg(
        F.min_by(F.struct("schema_hash", "schema"), _first(observed)).alias("b")
    )
    return first.select("baseline_type", F.col("b.schema_hash").alias("baseline_hash"), F.col("b.schema").alias("baseline"))


#: What with_baseline() adds.
OF_BASELINE = ("baseline_hash", "baseline", "leaves", "empty", "drift")


def with_baseline(observed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Add baseline_hash, baseline, leaves (its fields), empty (those that are null or missing) and drift: what an alert
    of the schema says, null where it is the baseline. known: baselines that hold already (of a table, or of earlier batches).
    """
    found = baselines(observed) if known is None else known
    # types are few as a rule, but nothing bounds them: whether to broadcast is left to their measured size
    joined = observed.join(found, F.col("event_type").eqNullSafe(F.col("baseline_type")), "left").drop("baseline_type")
    leaves, seen = P.leaves(F.col("baseline")), F.map_from_entries("schema")
    return joined.withColumn("leaves", leaves).withColumn("empty", F.filter(leaves, lambda path: P.nullish(seen, path))).withColumn("drift", _drift())


def _drift() -> Column:
    expected, seen = F.map_from_entries("baseline"), F.map_from_entries("schema")
    missing, added = P.missing_fields(expected, seen), P.added_fields(expected, seen)
    changed = P.changed_fields(expected, seen)
    evidence = F.struct(
        F.col("baseline_hash"),
        F.col("schema_hash").alias("observed_hash"),
        expected.alias("expected_schema"),
        seen.alias("observed_schema"),
        missing.alias("missing_fields"),
        added.alias("added_fields"),
        changed.alias("type_changed"),
    )
    size = lambda c: F.size(c).cast("string")
    message = F.concat(
        F.lit("Schema drift in "), F.col("event_type"), F.lit(" (missing="), size(missing), F.lit(", added="), size(added),
        F.lit(", type_changed="), size(changed), F.lit(")"),
    )
    found = F.struct(P.first_changed_field(changed, missing, added).alias("field_path"), message.alias("message"), F.to_json(evidence).alias("evidence_json"))
    return F.when(F.col("schema_hash") != F.col("baseline_hash"), found)


def drift() -> Column:
    """An array with the alert of an event whose schema is not the baseline; needs the columns of with_baseline()."""
    of = F.col("drift")
    return where(of.isNotNull(), alert_of("SCHEMA_DRIFT", "WARN", of["message"], of["evidence_json"], of["field_path"]))


def detect(observed: DataFrame) -> DataFrame:
    """Append the alerts of drift()."""
    return add(observed, drift())


def merged(rows: DataFrame, known: DataFrame) -> DataFrame:
    """versions() of several batches as one table; known: the baselines, whose schemas are ACTIVE."""
    by_hash = rows.groupBy("event_type", "schema_hash").agg(
        F.any_value("schema_json").alias("schema_json"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at")
    )
    joined = by_hash.join(known.select("baseline_type", "baseline_hash"), F.col("event_type").eqNullSafe(F.col("baseline_type")), "left")
    active = F.coalesce(F.col("schema_hash") == F.col("baseline_hash"), F.lit(False))
    status = F.when(active, F.lit("ACTIVE")).otherwise(F.lit("DRIFTING"))
    return joined.select("event_type", "schema_hash", "schema_json", "first_seen_at", "last_seen_at", status.alias("status"))


def prepare(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """describe() and with_baseline() in one."""
    return describe(events).with_baseline(known)
