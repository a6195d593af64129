"""Taking in events: validate, process, and bring the result tables up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from plumbline.config import Settings
from plumbline.functions.timing import plus
from plumbline.operators import alerts, envelope, health, incidents, metrics, schemas, spikes
from plumbline.operators.pipeline import Memory, process_observed
from plumbline.sources.arrival import numbered
from plumbline.sources.store import SCHEMAS, Store, released, stored


def _shaped(rows: DataFrame, table: str) -> DataFrame:
    """Columns of the table in order; those that rows lack are null."""
    fields = [f.strip().split(" ") for f in SCHEMAS[table].split(",")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def raw_events(processed: DataFrame) -> DataFrame:
    rows = processed.withColumnRenamed("seq", "id").withColumnRenamed("payload", "payload_json")
    return _shaped(rows, "raw_events")


def quality_alerts(processed: DataFrame) -> DataFrame:
    rows = alerts.exploded(processed).withColumn("id", alerts.alert_id(F.col("seq"), F.col("place"))).withColumn("status", F.lit("OPEN"))
    return _shaped(rows, "quality_alerts")


def stale_rows(found: DataFrame) -> DataFrame:
    """Alerts of stale sources as table rows; ids below zero, by the hash of source and time."""
    own = -F.abs(F.xxhash64("source", "created_at") % F.lit(1 << 62)) - 1
    return _shaped(found.withColumn("id", own).withColumn("status", F.lit("OPEN")), "quality_alerts")


def receipt(valid: DataFrame) -> DataFrame:
    """One row for a batch that was taken in: a random batch_id and the number of events."""
    return valid.agg(F.count("*").alias("accepted")).select(F.uuid().alias("batch_id"), "accepted")


def counted(processed: DataFrame, observation: Observation) -> DataFrame:
    """The same rows; once they are written, the observation has events_ingested and alerts_fired."""
    return processed.observe(
        observation, F.count(F.lit(1)).alias("events_ingested"), F.coalesce(F.sum(F.size("alerts")), F.lit(0)).alias("alerts_fired")
    )


def _covering(store: Store, before: int, column: str, since: Column) -> list[int]:
    """The batches before one that have rows at or after a time: those of a look-back, so few."""
    rows = store.read("batches", before).where(F.col(column) >= since).select("batch").distinct()
    return sorted(r["batch"] for r in rows.collect())


def process_batch(store: Store, valid: DataFrame, part: int, settings: Settings, numbers: int = 0) -> DataFrame | None:
    """Process a batch of valid events and write its part of each table; a part that is written again is replaced.

    Detectors go on from what the store has of the parts before: repeats look back over the duplicate window,
    the first schema of a type stays its baseline, runs of nulls and counts of windows continue. Returns the
    processed events, or None of an empty batch.
    """
    times = {c: F.col(c).cast("timestamp").alias(c) for c in ("event_timestamp", "received_at")}
    events = envelope.enrich(valid)
    events = events.select(*[times.get(c, F.col(c)) for c in ("seq", "event_id", "source", "event_type", "event_timestamp", "received_at", "payload", "payload_hash")])
    described = schemas.describe(events)
    kinds = described.kinds  # few rows, which have the extent of the batch, its versions and its baselines
    ends = {"first_received": F.min("first.received_at"), "last_received": F.max("last_seen_at"), "first_event": F.min("first_event_at"), "last_event": F.max("last_event_at")}
    extents = kinds.agg(*[end.alias(name) for name, end in ends.items()])
    extent = extents.first()
    if extent["first_received"] is None:
        return None
    at = lambda value, back=0.0: plus(F.lit(value).cast("timestamp"), -back)
    new = schemas.baselines(kinds).join(store.read("baselines", part).select("baseline_type"), "baseline_type", "left_anti")
    store.write("baselines", new, part)
    baselines = store.read("baselines", part + 1)
    observed = described.with_baseline(baselines)

    since = at(extent["first_received"], settings.duplicate_window)
    recent = store.read("raw_events", parts=_covering(store, part, "last_received", since)).where(F.col("received_at") >= since)
    windows = at(extent["first_event"], (settings.anomaly_windows + 1) * settings.window_size)
    counts = store.read("metric_windows", parts=_covering(store, part, "last_event", windows))
    counts = counts.where((F.col("metric_name") == "EVENT_COUNT") & (F.col("window_start") >= windows))
    last = store.read("batches", part).agg(F.max("batch")).first()[0]
    runs = stored(spikes.null_runs(observed, settings, None if last is None else store.read("null_runs", parts=[last])))
    memory = Memory(
        baselines=baselines,
        recent=recent.select(F.col("id").alias("seq"), "event_id", "received_at", "payload_hash"),
        null_runs=runs,
        window_counts=counts.groupBy("source", "event_type", "window_start").agg(F.sum("metric_value").cast("long").alias("events")),
    )
    seen = Observation()
    done = stored(counted(process_observed(observed, settings, memory=memory), seen))
    store.write("null_runs", spikes.null_state(runs), part)
    store.write("raw_events", raw_events(done), part)
    _write_alerts(store, done, seen.get["alerts_fired"], part, at(extent["first_received"], settings.incident_window), settings)
    store.write("schema_versions", _shaped(schemas.versions(kinds), "schema_versions"), part)
    store.write("metric_windows", _shaped(metrics.metric_windows(observed, settings), "metric_windows"), part)
    store.write("latest_events", health.latest_events(done), part)
    counters = [F.lit(seen.get[c]).cast("long").alias(c) for c in ("events_ingested", "alerts_fired")]
    store.write("batches", _shaped(extents.select(F.lit(part).alias("batch"), F.lit(numbers).cast("long").alias("numbers"), *counters, "*"), "batches"), part)
    return done


def _write_alerts(store: Store, done: DataFrame, fired: int, part: int, since: Column, settings: Settings) -> None:
    """Write the alerts of a part, so many, with their incidents; since: incidents opened before are over for all of them."""
    found = quality_alerts(done)
    if not fired:
        rows, new = found, store.spark.createDataFrame([], SCHEMAS["alert_incidents"])
    else:
        held = store.read("alert_incidents", part).where((F.col("status") == "OPEN") & (F.col("created_at") >= since))
        rows, new = incidents.attach(found, held, settings.incident_window)
    store.write("quality_alerts", _shaped(rows, "quality_alerts"), part)
    store.write("alert_incidents", _shaped(new, "alert_incidents"), part)


def current_incidents(store: Store) -> DataFrame:
    """ALERT_INCIDENTS of all parts, with the number of their alerts."""
    counts = store.read("quality_alerts").where("incident_id IS NOT NULL").groupBy(F.col("incident_id").alias("of")).agg(F.count("*").alias("alerts"))
    return store.read("alert_incidents").join(counts, F.col("id") == F.col("of")).drop("of")


def ingest(store: Store, events: DataFrame, part: int, settings: Settings, now: Column) -> DataFrame:
    """Validate a batch of events, process it and bring all tables up to date; returns the rejected events.

    Parts are to be numbered in the order in which they come. Events that bring no seq are numbered by their place in
    their source, after those of the parts before; so a part that comes again gives the same ids. Intermediate tables
    of a part are deleted at its end.
    """
    with released(store.spark):
        numbers = 0
        if "seq" not in events.columns:
            base = store.read("batches", part).agg(F.sum("numbers")).first()[0] or 0
            events, numbers = numbered(events, base)
        else:
            events = stored(events)  # a source is read once, as numbered() does
        valid, rejected = envelope.validate(events)
        process_batch(store, valid, part, settings, numbers)
        store.write("rejected_events", _shaped(rejected, "rejected_events"), part)
        refresh_health(store, part, settings, now)
    return store.read("rejected_events", parts=[part])


def current_versions(store: Store) -> DataFrame:
    """SCHEMA_VERSIONS of all parts together; one version of a type is ACTIVE."""
    return schemas.merged(store.read("schema_versions"), store.read("baselines"))


def current_metrics(store: Store, settings: Settings) -> DataFrame:
    """METRIC_WINDOWS of all parts together."""
    return metrics.merged(store.read("metric_windows"), settings)


def current_health(store: Store, before: int | None = None) -> DataFrame:
    """SOURCE_HEALTH as of the last refresh (before a part)."""
    last = Window.partitionBy("source").orderBy(F.desc("updated_at"))
    return store.read("source_health", before).withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def counters(store: Store) -> DataFrame:
    """One row: events ingested and alerts fired since the first batch."""
    return store.read("batches").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("events_ingested", "alerts_fired")])


def health_as_of(store: Store, settings: Settings, now: Column, part: int | None = None) -> DataFrame:
    """The health of all sources as of now, by what the parts up to one (by default all) brought; nothing is written.

    Reads the batches of the long look-back, and of the others only the last event of each source.
    """
    upto = None if part is None else part + 1
    since = plus(now.cast("timestamp"), -settings.long_look_back)
    extents = store.read("batches", upto)
    late = lambda c, t: F.coalesce(F.col(c) >= t, F.lit(False)).alias(c)
    windows_since = plus(since, -settings.window_size)
    covering = extents.select("batch", late("last_event", since), late("last_received", since), late("last_event", windows_since).alias("windows"))
    covering = covering.where("last_event OR last_received OR windows").collect()
    parts = [r["batch"] for r in covering if r["last_event"]]
    seen = store.read("latest_events", upto).withColumnsRenamed({"last_type": "event_type", "last_seen_at": "event_timestamp"})
    recent = store.read("raw_events", parts=parts).withColumnRenamed("id", "seq")
    raised = store.read("quality_alerts", 0) if part is None else store.read("quality_alerts", 0, after=-part - 1)
    alerted = store.read("quality_alerts", parts=[r["batch"] for r in covering if r["last_received"]]).unionByName(raised)
    windows = store.read("metric_windows", parts=[r["batch"] for r in covering if r["windows"]])
    return health.source_health(recent, alerted, metrics.merged(windows, settings), now, settings, health.latest_events(seen))


def refresh_health(store: Store, part: int, settings: Settings, now: Column) -> DataFrame:
    """Write the health of all sources as of now, and alerts of those that have gone stale since the last part."""
    found = health_as_of(store, settings, now, part)
    new = health.stale_alerts(found, current_health(store, part), settings)
    stale_part = -part - 1  # parts below zero hold the alerts that a refresh raises
    store.write("quality_alerts", stale_rows(new), stale_part)
    store.write("source_health", _shaped(found, "source_health"), part)
    return new
