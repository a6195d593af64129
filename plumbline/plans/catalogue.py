"""Registered queries over the driver tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.config import Bounds, parse_formats
from plumbline.functions import payload as P
from plumbline.functions.timing import micros, plus, seconds_between, window_start
from plumbline.operators import alerts, duplicates, envelope, fields, health, incidents, metrics, schemas, spikes
from plumbline.operators.pipeline import process_observed
from plumbline.plans import ingest, reads
from plumbline.plans.inputs import EVENTS_SQL, SETTINGS, events, table
from plumbline.sources.events import from_messages, read_events, to_messages, write_json
from plumbline.sources.store import Store, new_folder, stored
from plumbline.streaming.replay import arrived, cuts, run, stream_processed
from plumbline.streaming.state import streamed_alerts
from plumbline.streaming.windows import streamed_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _with(*parts: str) -> str:
    """A SELECT over common table expressions; those that the SELECT does not need cost nothing."""
    return "WITH " + ",\n".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1]


# --- Intermediate results, in SQL ---------------------------------------------------------------

_LATE = """
late AS (
  SELECT *, epoch_us(received_at) - epoch_us(event_timestamp) AS late_us FROM stream),
late_alerts AS (
  SELECT seq, 'LATE_EVENT' AS alert_type, CASE WHEN late_us > 3000000000 THEN 'WARN' ELSE 'INFO' END AS severity, source, event_type,
    NULL AS field_path, received_at, 'Event arrived ' || (late_us // 1000000) || 's after event_timestamp (threshold PT5M)' AS message, 1 AS stage
  FROM late WHERE late_us > 300000000)
"""
_RANGE = """
range_alerts AS (
  SELECT seq, 'FIELD_OUT_OF_RANGE' AS alert_type, 'WARN' AS severity, source, event_type, 'v' AS field_path, received_at,
    NULL AS message, 2 AS stage
  FROM stream WHERE NOT v_text AND v_number > 15000)
"""
_DUPLICATES = """
repeats AS (
  SELECT *, epoch_us(received_at) - lag(epoch_us(received_at)) OVER (PARTITION BY event_id ORDER BY received_at, seq) <= 300000000 AS by_id,
    min((received_at, seq, event_id)) OVER (PARTITION BY payload_hash ORDER BY received_at RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW) AS first
  FROM stream),
marked AS (
  SELECT *, coalesce(by_id, false) AS repeated_id,
    CASE WHEN (first[1], first[2]) < (received_at, seq) THEN first[3] END AS first_event_id
  FROM repeats),
duplicate_alerts AS (
  SELECT seq, 'DUPLICATE_EVENT' AS alert_type, 'INFO' AS severity, source, event_type, NULL AS field_path, received_at,
    'Repeated event_id ' || event_id AS message, 3 AS stage FROM marked WHERE repeated_id
  UNION ALL
  SELECT seq, 'DUPLICATE_EVENT', 'INFO', source, event_type, NULL, received_at,
    'Repeated payload hash within PT5M; first event_id=' || first_event_id, 4 FROM marked WHERE first_event_id <> event_id)
"""
_SCHEMAS = """
leveled AS (
  SELECT seq, event_type, received_at, source, event_timestamp, unnest(json_keys(payload)) AS key, payload FROM stream),
typed AS (
  SELECT *, json_type(payload, '$.' || key) AS t FROM leveled),
entries AS (
  SELECT seq, key AS path, CASE WHEN t IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'NUMBER' WHEN t = 'VARCHAR' THEN 'STRING' ELSE t END AS type FROM typed
  UNION ALL
  SELECT seq, key || '.' || k2, CASE WHEN t2 IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'NUMBER' WHEN t2 = 'VARCHAR' THEN 'STRING' ELSE t2 END
  FROM (SELECT seq, key, k2, json_type(payload, '$.' || key || '.' || k2) AS t2
        FROM (SELECT seq, key, payload, unnest(json_keys(payload, '$.' || key)) AS k2 FROM typed WHERE t = 'OBJECT'))),
described AS (
  SELECT seq, list((path, type) ORDER BY path) AS schema, sha256(string_agg(path || '=' || type || ';', '' ORDER BY path)) AS schema_hash
  FROM entries GROUP BY seq),
observed AS (
  SELECT s.*, d.schema, d.schema_hash FROM stream s JOIN described d USING (seq)),
firsts AS (
  SELECT event_type, arg_min(schema_hash, (received_at, seq)) AS baseline_hash, arg_min(schema, (received_at, seq)) AS baseline
  FROM observed GROUP BY event_type),
compared AS (
  SELECT o.*, f.baseline_hash, f.baseline,
    list_sort([b[1] FOR b IN f.baseline IF NOT list_contains([x[1] FOR x IN o.schema], b[1])]) AS missing,
    list_sort([x[1] FOR x IN o.schema IF NOT list_contains([b[1] FOR b IN f.baseline], x[1])]) AS added,
    list_sort([x[1] FOR x IN o.schema IF list_contains([b[1] FOR b IN f.baseline], x[1]) AND NOT list_contains(f.baseline, x)]) AS changed
  FROM observed o JOIN firsts f USING (event_type)),
drift_alerts AS (
  SELECT seq, 'SCHEMA_DRIFT' AS alert_type, 'WARN' AS severity, source, event_type, coalesce(changed[1], missing[1], added[1]) AS field_path, received_at,
    'Schema drift in ' || event_type || ' (missing=' || len(missing) || ', added=' || len(added) || ', type_changed=' || len(changed) || ')' AS message, 5 AS stage
  FROM compared WHERE schema_hash <> baseline_hash),
versions AS (
  SELECT event_type, schema_hash, min(received_at) AS first_seen_at, max(received_at) AS last_seen_at,
    CASE WHEN schema_hash = any_value(baseline_hash) THEN 'ACTIVE' ELSE 'DRIFTING' END AS status
  FROM compared GROUP BY event_type, schema_hash)
"""
_NULLS = """
samples AS (
  SELECT seq, received_at, source, event_type, to_timestamp(epoch_us(event_timestamp) // 21600000000 * 21600)::TIMESTAMP AS window_start, path AS field_path,
    CASE WHEN coalesce(list_filter(schema, lambda x: x[1] = path)[1][2], 'NULL') = 'NULL' THEN 1 ELSE 0 END AS nullish
  FROM (SELECT *, unnest([b[1] FOR b IN baseline IF b[2] <> 'OBJECT']) AS path FROM compared)),
changes AS (
  SELECT *, window_start IS DISTINCT FROM lag(window_start) OVER (PARTITION BY source, event_type, field_path ORDER BY received_at, seq) AS change FROM samples),
islands AS (
  SELECT *, sum(change::INT) OVER (PARTITION BY source, event_type, field_path ORDER BY received_at, seq) AS island FROM changes),
running AS (
  SELECT *, count(*) OVER w AS total_count, (sum(nullish) OVER w)::BIGINT AS null_count FROM islands
  WINDOW w AS (PARTITION BY source, event_type, field_path, island ORDER BY received_at, seq ROWS UNBOUNDED PRECEDING)),
null_spikes AS (
  SELECT *, null_count / total_count AS null_rate FROM running
  WHERE total_count >= 3 AND null_count / total_count > 0.5
    AND CASE WHEN total_count > 1 THEN (null_count - nullish) / (total_count - 1) ELSE 0 END <= 0.5),
null_alerts AS (
  SELECT seq, 'NULL_SPIKE' AS alert_type, 'WARN' AS severity, source, event_type, field_path, received_at,
    'Null spike for ' || field_path || ' in ' || event_type || ' (' || null_count || '/' || total_count || ')' AS message, 6 AS stage FROM null_spikes)
"""
_ANOMALIES = """
windowed AS (
  SELECT seq, received_at, source, event_type, to_timestamp(epoch_us(event_timestamp) // 21600000000 * 21600)::TIMESTAMP AS window_start FROM stream),
counts AS (SELECT source, event_type, window_start, count(*) AS events FROM windowed GROUP BY ALL),
based AS (
  SELECT *, count(*) OVER w AS history, avg(events) OVER w AS baseline FROM counts
  WINDOW w AS (PARTITION BY source, event_type ORDER BY window_start RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)),
spread AS (
  SELECT seq, received_at, source, event_type, window_start + k * INTERVAL 6 HOUR AS window_start, k FROM windowed, (SELECT unnest([0, 1, 2]) AS k)),
as_of AS (
  SELECT *, count(*) FILTER (k = 0) OVER w AS events_so_far, count(*) FILTER (k = 1) OVER w AS n1, count(*) FILTER (k = 2) OVER w AS n2
  FROM spread WINDOW w AS (PARTITION BY source, event_type, window_start ORDER BY received_at, seq ROWS UNBOUNDED PRECEDING)),
ratios AS (
  SELECT seq, received_at, source, event_type, window_start, events_so_far, (n1 > 0)::BIGINT + (n2 > 0)::BIGINT AS history,
    (n1 + n2) / nullif((n1 > 0)::BIGINT + (n2 > 0)::BIGINT, 0) AS baseline FROM as_of WHERE k = 0),
anomalies AS (
  SELECT *, events_so_far / baseline AS ratio FROM ratios
  WHERE history >= 2 AND events_so_far >= 3 AND (events_so_far - 1) / baseline <= 1.5 AND events_so_far / baseline > 1.5),
anomaly_alerts AS (
  SELECT seq, 'ANOMALY_SPIKE' AS alert_type, 'WARN' AS severity, source, event_type, NULL AS field_path, received_at,
    'Anomaly spike in ' || event_type || ' window (' || events_so_far || ' vs baseline ' || format('{:.2f}', baseline) || ')' AS message, 7 AS stage FROM anomalies)
"""
_ALL = """
every_alert AS (
  SELECT * FROM late_alerts UNION ALL SELECT * FROM range_alerts UNION ALL SELECT * FROM duplicate_alerts UNION ALL SELECT * FROM drift_alerts
  UNION ALL SELECT * FROM null_alerts UNION ALL SELECT * FROM anomaly_alerts),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY stage, field_path) - 1 AS place, seq * 1048576 + row_number() OVER (PARTITION BY seq ORDER BY stage, field_path) - 1 AS id
  FROM every_alert),
processed AS (
  SELECT s.*, coalesce(n, 0) AS n_alerts,
    CASE WHEN n IS NULL THEN 'OK' WHEN dup THEN 'DUPLICATE' WHEN late THEN 'LATE' ELSE 'FLAGGED' END AS quality_status
  FROM stream s LEFT JOIN (
    SELECT seq, count(*) AS n, bool_or(alert_type = 'DUPLICATE_EVENT') AS dup, bool_or(alert_type = 'LATE_EVENT') AS late FROM every_alert GROUP BY seq) USING (seq))
"""
_METRICS = """
event_windows AS (
  SELECT source, event_type, to_timestamp(epoch_us(event_timestamp) // 21600000000 * 21600)::TIMESTAMP AS window_start, count(*)::DOUBLE AS n FROM stream GROUP BY ALL),
null_windows AS (
  SELECT source, event_type, window_start, field_path, count(*)::DOUBLE AS total, sum(nullish)::DOUBLE AS nulls FROM samples GROUP BY ALL),
metric_windows AS (
  SELECT source, event_type, window_start, 'EVENT_COUNT' AS metric_name, n AS metric_value FROM event_windows
  UNION ALL SELECT source, event_type, window_start, 'NULL_TOTAL:' || field_path, total FROM null_windows
  UNION ALL SELECT source, event_type, window_start, 'NULL_COUNT:' || field_path, nulls FROM null_windows
  UNION ALL SELECT source, event_type, window_start, 'NULL_RATE:' || field_path, nulls / total FROM null_windows),
metrics_long AS (
  SELECT source, event_type, window_start, window_start + INTERVAL 6 HOUR AS window_end, metric_name, metric_value FROM metric_windows)
"""
_NOW = "clock AS (SELECT max(event_timestamp) AS t FROM stream)"
_HEALTH = """
base AS (
  SELECT source, max((event_timestamp, seq, event_type)) AS l, count(*) FILTER (event_timestamp > t - INTERVAL 5 MINUTE) AS events_last_5m,
    count(*) FILTER (event_timestamp > t - INTERVAL 1 HOUR) AS events_last_1h,
    count(*) FILTER (event_timestamp > t - INTERVAL 1 HOUR AND quality_status = 'DUPLICATE') AS dup,
    count(*) FILTER (event_timestamp > t - INTERVAL 1 HOUR AND quality_status = 'LATE') AS lat
  FROM processed, clock GROUP BY source),
rated AS (
  SELECT source, l[1] AS last_seen_at, l[3] AS last_type, events_last_5m, events_last_1h,
    CASE WHEN events_last_1h = 0 THEN 0.0::DOUBLE ELSE dup / events_last_1h END AS duplicate_rate,
    CASE WHEN events_last_1h = 0 THEN 0.0::DOUBLE ELSE lat / events_last_1h END AS late_event_rate,
    CASE WHEN lower(source || ' ' || l[3]) LIKE '%rss%' OR lower(source || ' ' || l[3]) LIKE '%coindesk%' THEN 1800.0::DOUBLE
      WHEN lower(source || ' ' || l[3]) LIKE '%document%' OR lower(source || ' ' || l[3]) LIKE '%pipeline%' OR lower(source || ' ' || l[3]) LIKE '%sourcehero%' THEN 86400.0::DOUBLE
      ELSE 300.0::DOUBLE END AS stale_seconds
  FROM base),
null_max AS (
  SELECT source, max(metric_value) AS null_rate FROM metrics_long, clock WHERE metric_name LIKE 'NULL_RATE:%' AND window_end > t - INTERVAL 1 HOUR GROUP BY source),
recent AS (SELECT source, count(*) AS n FROM every_alert, clock WHERE received_at > t - INTERVAL 1 HOUR GROUP BY source),
joined AS (
  SELECT r.*, coalesce(m.null_rate, 0.0::DOUBLE) AS null_rate, coalesce(a.n, 0) AS recent_alerts,
    epoch_us(last_seen_at) < epoch_us(t) - stale_seconds * 1000000 AS stale
  FROM rated r CROSS JOIN clock LEFT JOIN null_max m USING (source) LEFT JOIN recent a USING (source)),
scored AS (
  SELECT *, greatest(0, least(100, 100.0::DOUBLE - least(duplicate_rate * 35, 35) - least(late_event_rate * 25, 25) - least(null_rate * 25, 25)
    - least(recent_alerts * 5, 20) - CASE WHEN stale THEN 35 ELSE 0 END))::DOUBLE AS health_score FROM joined),
health AS (
  SELECT *, CASE WHEN stale THEN 'STALE' WHEN health_score < 60 THEN 'UNHEALTHY' ELSE 'HEALTHY' END AS status FROM scored)
"""
_PIPELINE = (EVENTS_SQL, _LATE, _RANGE, _DUPLICATES, _SCHEMAS, _NULLS, _ANOMALIES, _ALL)
_ACTIONS = """
alert_table AS (SELECT id, alert_type, source, event_type, received_at AS created_at FROM placed),
lifecycle AS (
  SELECT *, CASE WHEN id % 3 = 0 THEN 'RESOLVED' WHEN id % 2 = 0 THEN 'ACKNOWLEDGED' ELSE 'OPEN' END AS status FROM alert_table)
"""


# --- Intermediate results, in Spark -------------------------------------------------------------


def _observed(spark: SparkSession, d: str) -> DataFrame:
    return schemas.prepare(envelope.enrich(events(spark, d)))


def _processed(spark: SparkSession, d: str) -> DataFrame:
    return process_observed(_observed(spark, d), SETTINGS)


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts with an id that follows from the event and the place."""
    found = alerts.exploded(_processed(spark, d))
    return found.withColumn("id", alerts.alert_id(F.col("seq"), F.col("place")))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.metric_windows(_observed(spark, d), SETTINGS)


_taken_in: dict[tuple[str, str], Store] = {}


def _state_of(spark: SparkSession, d: str) -> str:
    """The folder, and the size and time of change of its events."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    held = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{d}@{held.getContentSummary(place).getLength()}@{held.getFileStatus(place).getModificationTime()}"


def tables(spark: SparkSession, d: str) -> Store:
    """The result tables with all events taken in, once for each session and state of the folder; read queries look at these."""
    key = (spark.sparkContext.applicationId, _state_of(spark, d))
    if key not in _taken_in or not _taken_in[key].exists("batches"):  # somebody may have cleared the folder
        store = Store(spark, new_folder(spark))
        ingest.ingest(store, events(spark, d), 0, SETTINGS, _now(spark, d))
        _taken_in[key] = store
    return _taken_in[key]


def _local(rows: DataFrame) -> DataFrame:
    """Times of stored tables as the driver tables have them, without a zone."""
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in rows.dtypes])


def _now(spark: SparkSession, d: str):
    """The time of the last event, read once as the clock of the query."""
    return F.lit(table(spark, d, "events").agg(F.max("ts")).first()[0]).cast("timestamp_ntz")


def _actions(found: DataFrame) -> DataFrame:
    """Every second alert is acknowledged after an hour, every third resolved after two."""
    at = F.col("created_at")
    acknowledge = found.where("id % 2 = 0").select(
        "id", F.lit("acknowledge").alias("action"), plus(at, 3600).alias("at"), F.when(F.col("id") % 4 == 0, F.lit("operator")).alias("by"), F.lit(None).cast("string").alias("root_cause")
    )
    resolve = found.where("id % 3 = 0").select(
        "id", F.lit("resolve").alias("action"), plus(at, 7200).alias("at"), F.lit(None).cast("string").alias("by"), F.when(F.col("id") % 9 == 0, F.lit("upstream")).alias("root_cause")
    )
    return acknowledge.unionByName(resolve)


# --- Sources, filters, projections --------------------------------------------------------------


@_query(_with(EVENTS_SQL, _LATE, "SELECT seq, source, event_type, late_us // 1000000 AS lateness_seconds, CASE WHEN late_us > 3000000000 THEN 'WARN' ELSE 'INFO' END AS severity FROM late WHERE late_us > 300000000"))
def late_events(spark, d):
    event_time, received = F.col("event_timestamp"), F.col("received_at")
    severity = fields.lateness_severity(event_time, received, SETTINGS.late_threshold)
    rows = events(spark, d).select("seq", "source", "event_type", seconds_between(event_time, received).alias("lateness_seconds"), severity.alias("severity"))
    return rows.where("severity IS NOT NULL")


@_query(_with(EVENTS_SQL, _LATE, "SELECT source, severity, count(*) AS n FROM late_alerts GROUP BY ALL"))
def late_severity_counts(spark, d):
    return late_events(spark, d).groupBy("source", "severity").agg(F.count("*").alias("n"))


@_query("""
SELECT 'value' AS field_path, event_id AS row_id, value FROM events WHERE value < 1 OR value > 100
UNION ALL SELECT 'l_quantity', l_orderkey * 8 + l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45
""")
def field_range_alerts(spark, d):
    """Range checks of columns; the lines of an order number below 8."""
    outside = lambda t, column, row, bounds: table(spark, d, t).where(fields.out_of_range(F.col(column), bounds)).select(
        F.lit(column).alias("field_path"), row.cast("long").alias("row_id"), F.col(column).alias("value")
    )
    first = outside("events", "value", F.col("event_id"), Bounds(1, 100))
    return first.unionByName(outside("lineitem", "l_quantity", F.col("l_orderkey") * 8 + F.col("l_linenumber"), Bounds(high=45)))


@_query("""
SELECT 'c_name' AS field_path, c_custkey AS row_id, c_name AS value FROM customer WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]*[02468]')
UNION ALL SELECT 'p_brand', p_partkey, p_brand FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[1-3][0-9]')
UNION ALL SELECT 'url', page_id, url FROM pages WHERE NOT regexp_full_match(url, 'https://[a-z0-9.]*/[^?]*')
""")
def field_format_alerts(spark, d):
    """Format checks of columns, with a configuration in text."""
    formats = parse_formats("c_name=Customer#[0-9]*[02468],p_brand=Brand#[1-3][0-9],url=https://[a-z0-9.]*/[^?]*,broken")
    parts = [("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_brand"), ("pages", "page_id", "url")]
    found = [
        table(spark, d, t)
        .where(~fields.matches_whole(F.col(column), formats[column]))
        .select(F.lit(column).alias("field_path"), F.col(key).alias("row_id"), F.col(column).alias("value"))
        for t, key, column in parts
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@_query(_with(EVENTS_SQL, """
SELECT seq, message, count(*) AS n FROM (
  SELECT seq, concat_ws('; ', CASE WHEN seq % 53 = 0 THEN 'event_id: must not be blank' END, CASE WHEN seq % 59 = 0 THEN 'source: must not be blank' END,
    CASE WHEN seq % 61 = 0 THEN 'event_timestamp: must not be null' END, CASE WHEN seq % 67 = 0 THEN 'payload: must not be null' END) AS message FROM stream)
WHERE message <> '' GROUP BY ALL"""))
def envelope_rejects(spark, d):
    """Rejected events by violation, of events with blanks and nulls put in."""
    s = F.col("seq")
    broken = events(spark, d).select(
        "seq",
        F.when(s % 53 == 0, F.lit(" \t")).otherwise(F.col("event_id")).alias("event_id"),
        F.when(s % 59 != 0, F.col("source")).alias("source"),
        "event_type",
        F.when(s % 61 != 0, F.col("event_timestamp")).alias("event_timestamp"),
        F.when(s % 67 != 0, F.col("payload")).alias("payload"),
    )
    _, rejected = envelope.validate(broken)
    return rejected.groupBy("seq", F.col("violations").alias("message")).agg(F.count("*").alias("n"))


@_query(_with(EVENTS_SQL, "SELECT source || '|' || event_type AS partition_key, count(*) AS n FROM stream GROUP BY ALL"))
def partition_key_distribution(spark, d):
    return events(spark, d).groupBy(envelope.partition_key().alias("partition_key")).agg(F.count("*").alias("n"))


@_query(_with(EVENTS_SQL, "SELECT seq, payload_hash FROM stream"))
def payload_hash(spark, d):
    """Hashes of canonical JSON, of payloads whose keys come in another order and with blanks."""
    swapped = F.regexp_replace("payload", r'^\{("k":[^,]*),("v":"?-?[0-9]+"?)(.*)\}$', r"{ $2 , $1$3 }")
    return events(spark, d).select("seq", P.payload_hash(swapped).alias("payload_hash"))


@_query(_with(EVENTS_SQL, _DUPLICATES, "SELECT seq, event_id FROM marked WHERE repeated_id"))
def duplicate_event_id(spark, d):
    return duplicates.repeated_ids(events(spark, d), SETTINGS.duplicate_window).where("repeated_id").select("seq", "event_id")


@_query(_with(EVENTS_SQL, _DUPLICATES, "SELECT seq, event_id, first_event_id FROM marked WHERE first_event_id <> event_id"))
def duplicate_payload(spark, d):
    found = duplicates.first_of_payload(envelope.enrich(events(spark, d)), SETTINGS.duplicate_window)
    return found.where("first_event_id <> event_id").select("seq", "event_id", "first_event_id")


@_query("SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_doc_id FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_documents(spark, d):
    hashed = table(spark, d, "documents").select(F.sha2("text", 256).alias("text_hash"), "doc_id")
    return hashed.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id")).where("copies > 1")


# --- Schemas ------------------------------------------------------------------------------------


@_query(_with(EVENTS_SQL, _SCHEMAS, "SELECT path, type, count(*) AS n FROM entries GROUP BY ALL"))
def schema_inference(spark, d):
    found = events(spark, d).select(F.inline(P.schema_entries(F.col("payload"))))
    return found.groupBy("path", "type").agg(F.count("*").alias("n"))


@_query(_with(EVENTS_SQL, _SCHEMAS, "SELECT * FROM versions"))
def schema_versions(spark, d):
    return _local(reads.schema_list(ingest.current_versions(tables(spark, d)))).drop("schema_json")


@_query(_with(EVENTS_SQL, _SCHEMAS, "SELECT seq, source, event_type, field_path, message FROM drift_alerts"))
def schema_drift_alerts(spark, d):
    return schemas.detect(_observed(spark, d)).select("seq", F.inline("alerts")).select("seq", "source", "event_type", "field_path", "message")


@_query(_with(EVENTS_SQL, _SCHEMAS, """
SELECT event_type, count(*) AS versions, count(*) FILTER (status = 'DRIFTING') AS drifting, max(schema_hash) FILTER (status = 'ACTIVE') AS active_hash
FROM versions GROUP BY event_type"""))
def schema_drift_summary(spark, d):
    return reads.schema_summary(schemas.versions(schemas.describe(envelope.enrich(events(spark, d))).kinds))


# --- Nulls, metrics, anomalies ------------------------------------------------------------------


@_query(_with(EVENTS_SQL, _SCHEMAS, _NULLS, "SELECT seq, source, event_type, field_path, window_start, null_count, total_count, null_rate FROM null_spikes"))
def null_spike_alerts(spark, d):
    found = spikes.null_spikes(spikes.null_runs(_observed(spark, d), SETTINGS), SETTINGS)
    return found.select("seq", "source", "event_type", "field_path", "window_start", "null_count", "total_count", "null_rate")


@_query("""
SELECT source, count(*) AS total, count(*) FILTER (quality IS NULL) AS nulls, count(*) FILTER (quality IS NULL) / count(*) AS null_rate
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
""")
def null_rates_by_source(spark, d):
    """Rates of documents without a label by source."""
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    sums = joined.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("quality").isNull()).alias("nulls"))
    return sums.withColumn("null_rate", health.rate(F.col("nulls"), F.col("total")))


@_query(_with(EVENTS_SQL, "SELECT event_type, to_timestamp(epoch_us(event_timestamp) // 3600000000 * 3600)::TIMESTAMP AS window_start, count(*) AS n FROM stream GROUP BY ALL"))
def event_count_windows(spark, d):
    return events(spark, d).groupBy("event_type", window_start(F.col("event_timestamp"), 3600).alias("window_start")).agg(F.count("*").alias("n"))


@_query(_with(EVENTS_SQL, _SCHEMAS, _NULLS, _METRICS, "SELECT * FROM metrics_long"))
def metric_windows_long(spark, d):
    return _metrics(spark, d)


@_query(_with(EVENTS_SQL, _SCHEMAS, _NULLS, _METRICS, """
SELECT window_start, metric_value FROM metrics_long
WHERE source = 'rss-1' AND event_type = 'click' AND metric_name = 'EVENT_COUNT' AND window_end <= TIMESTAMP '2024-01-15 03:00:00'
ORDER BY window_start DESC LIMIT 5"""))
def recent_completed_windows(spark, d):
    before = F.lit("2024-01-15 03:00:00").cast("timestamp_ntz")
    found = metrics.recent_windows(metrics.event_counts(events(spark, d), SETTINGS), "rss-1", "click", "EVENT_COUNT", before, 5)
    return found.select("window_start", "metric_value")


@_query(_with(EVENTS_SQL, _ANOMALIES, "SELECT source, event_type, window_start, events, history, baseline FROM based WHERE history > 0"))
def anomaly_baseline(spark, d):
    return spikes.baselines(spikes.window_counts(events(spark, d), SETTINGS.window_size), SETTINGS).where("history > 0")


@_query(_with(EVENTS_SQL, _ANOMALIES, "SELECT seq, source, event_type, window_start, events_so_far, baseline, ratio FROM anomalies"))
def anomaly_spike_alerts(spark, d):
    return spikes.anomaly_spikes(events(spark, d), SETTINGS).select("seq", "source", "event_type", "window_start", "events_so_far", "baseline", "ratio")


# --- The pipeline and what is read from it --------------------------------------------------------


@_query(_with(*_PIPELINE, "SELECT seq, n_alerts, quality_status FROM processed"))
def quality_status(spark, d):
    return _processed(spark, d).select("seq", F.size("alerts").cast("long").alias("n_alerts"), "quality_status")


@_query(_with(*_PIPELINE, "SELECT alert_type, severity, count(*) AS n FROM every_alert GROUP BY ALL"))
def alerts_by_type(spark, d):
    return _alerts(spark, d).groupBy("alert_type", "severity").agg(F.count("*").alias("n"))


@_query(_with(*_PIPELINE, "SELECT id, alert_type, severity, source, event_type, field_path, received_at AS created_at FROM placed"))
def alert_rows(spark, d):
    return _alerts(spark, d).select("id", "alert_type", "severity", "source", "event_type", "field_path", "created_at")


@_query(_with(EVENTS_SQL, "SELECT DISTINCT source FROM stream"))
def distinct_sources(spark, d):
    return reads.distinct_sources(events(spark, d))


@_query(_with(EVENTS_SQL, "SELECT source, l[3] AS last_type, l[1] AS last_seen_at FROM (SELECT source, max((event_timestamp, seq, event_type)) AS l FROM stream GROUP BY source)"))
def latest_event_per_source(spark, d):
    return health.latest_events(events(spark, d)).drop("seq")


@_query(_with(*_PIPELINE, _METRICS, _NOW, _HEALTH, "SELECT source, last_type, stale_seconds FROM health"))
def freshness_policy(spark, d):
    last = health.latest_events(events(spark, d))
    return last.select("source", "last_type", health.stale_after(F.col("source"), F.col("last_type"), SETTINGS).alias("stale_seconds"))


@_query(_with(*_PIPELINE, _METRICS, _NOW, _HEALTH, "SELECT source, events_last_5m, events_last_1h, duplicate_rate, late_event_rate FROM health"))
def source_rates(spark, d):
    found = health.rates(_processed(spark, d), _now(spark, d), SETTINGS)
    return found.select("source", "events_last_5m", "events_last_1h", "duplicate_rate", "late_event_rate")


@_query(_with(EVENTS_SQL, _SCHEMAS, _NULLS, _METRICS, _NOW, "SELECT source, max(metric_value) AS null_rate FROM metrics_long, clock WHERE metric_name LIKE 'NULL_RATE:%' AND window_end > t - INTERVAL 1 HOUR GROUP BY source"))
def source_null_rate(spark, d):
    return health.null_rates(_metrics(spark, d), _now(spark, d), SETTINGS)


@_query(_with(*_PIPELINE, _METRICS, _NOW, _HEALTH, "SELECT source, status, last_seen_at, events_last_5m, events_last_1h, duplicate_rate, late_event_rate, null_rate, round(health_score, 6) AS health_score FROM health"))
def source_health(spark, d):
    return _local(reads.health_list(ingest.current_health(tables(spark, d)))).drop("updated_at").withColumn("health_score", F.round("health_score", 6))


_LATER = "clock AS (SELECT max(event_timestamp) AS taken_in, max(event_timestamp) + INTERVAL 7 MINUTE AS t FROM stream)"
_HEALTH_LATER = _HEALTH.replace("FROM every_alert, clock", """FROM (
    SELECT source, received_at FROM every_alert UNION ALL
    SELECT source, taken_in FROM rated, clock WHERE epoch_us(last_seen_at) < epoch_us(taken_in) - stale_seconds * 1000000), clock""")


@_query(_with(*_PIPELINE, _METRICS, _LATER, _HEALTH_LATER, "SELECT source, status, last_seen_at, events_last_5m, events_last_1h, duplicate_rate, late_event_rate, null_rate, round(health_score, 6) AS health_score FROM health"))
def source_health_as_of_read(spark, d):
    """Health seven minutes after the last batch, with the alerts of silent sources that its refresh raised."""
    found = ingest.health_as_of(tables(spark, d), SETTINGS, plus(_now(spark, d), 420.0)).drop("last_type", "stale_seconds")
    return _local(found).drop("updated_at").withColumn("health_score", F.round("health_score", 6))


@_query(_with(EVENTS_SQL, """
days AS (SELECT unnest(range(0, 30)) AS day),
seen AS (
  SELECT day, source, max((event_timestamp, seq, event_type)) AS l FROM stream, days
  WHERE event_timestamp <= TIMESTAMP '2024-01-01 12:00:00' + to_days(day::INTEGER) GROUP BY ALL),
allowed AS (
  SELECT day, source, l[1] AS last_seen_at, lower(source || ' ' || l[3]) AS text FROM seen),
statuses AS (
  SELECT day, source, epoch(last_seen_at) < epoch(TIMESTAMP '2024-01-01 12:00:00' + to_days(day::INTEGER))
    - CASE WHEN text LIKE '%rss%' OR text LIKE '%coindesk%' THEN 1800 WHEN text LIKE '%document%' OR text LIKE '%pipeline%' OR text LIKE '%sourcehero%' THEN 86400 ELSE 300 END AS stale
  FROM allowed)""", """
SELECT day, source FROM (SELECT *, lag(stale) OVER (PARTITION BY source ORDER BY day) AS before FROM statuses) WHERE stale AND NOT coalesce(before, false)"""))
def stale_transitions(spark, d):
    """The days on which a source goes stale, of a health snapshot at noon of each of 30 days."""
    noon = F.timestamp_add("DAY", F.col("day"), F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))
    rows = events(spark, d).select("source", "event_type", "event_timestamp", "seq")
    # the last event of each day's noon to noon, then the last so far: an event counts once, not once for each day
    first_day = F.greatest(F.lit(0), F.timestamp_diff("DAY", F.lit("2023-12-31 12:00:00").cast("timestamp_ntz"), F.timestamp_add("MICROSECOND", F.lit(-1), F.col("event_timestamp"))))
    daily = rows.groupBy("source", first_day.cast("long").alias("day")).agg(F.max(F.struct("event_timestamp", "seq", "event_type")).alias("l"))
    grid = daily.select("source").distinct().select("source", F.explode(F.sequence(F.lit(0), F.lit(29)).cast("array<bigint>")).alias("day"))
    so_far = Window.partitionBy("source").orderBy("day")
    last = grid.join(daily, ["source", "day"], "left").withColumn("l", F.max("l").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    allowed = health.stale_after(F.col("source"), F.col("l.event_type"), SETTINGS)
    last = last.where("l IS NOT NULL").withColumn("stale", micros(F.col("l.event_timestamp")) < micros(noon) - (allowed * 1_000_000).cast("long"))
    before = F.coalesce(F.lag("stale").over(so_far), F.lit(False))
    return last.withColumn("new", F.col("stale") & ~before).where("new").select("day", "source")


@_query(_with(*_PIPELINE, _METRICS, _NOW, _HEALTH, """
SELECT (SELECT count(*) FROM stream) AS total_events, (SELECT count(DISTINCT source) FROM stream) AS active_sources,
  (SELECT count(*) FROM every_alert, clock WHERE received_at > t - INTERVAL 24 HOUR) AS alerts_last_24h,
  (SELECT count(*) FROM health WHERE status IN ('UNHEALTHY', 'STALE')) AS unhealthy_sources"""))
def dashboard_summary(spark, d):
    store, now = tables(spark, d), _now(spark, d)
    found = store.read("quality_alerts").where("alert_type <> 'STALE_SOURCE'")  # raised by the refresh, at the clock itself
    return reads.dashboard_summary(store.read("raw_events"), found, ingest.current_health(store), now.cast("timestamp"))


@_query(_with(EVENTS_SQL, "SELECT seq, event_id, source, event_type, received_at FROM stream ORDER BY received_at DESC, seq DESC LIMIT 20"))
def recent_events(spark, d):
    return reads.recent_events(events(spark, d).select("seq", "event_id", "source", "event_type", "received_at"))


@_query(_with(*_PIPELINE, "SELECT id, alert_type, source, received_at AS created_at FROM placed WHERE alert_type = 'SCHEMA_DRIFT' AND source = 'rss-1' ORDER BY received_at DESC, id DESC LIMIT 50"))
def alerts_filtered(spark, d):
    return reads.alerts_list(_alerts(spark, d), kind="SCHEMA_DRIFT", source="rss-1").select("id", "alert_type", "source", "created_at")


@_query(_with(EVENTS_SQL, _SCHEMAS, _NULLS, _METRICS, "SELECT * FROM metrics_long WHERE source = 'coindesk' AND metric_name = 'NULL_RATE:k' ORDER BY window_start DESC, metric_name, source, event_type LIMIT 100"))
def metric_search(spark, d):
    return reads.metric_search(_metrics(spark, d), source="coindesk", metric_name="NULL_RATE:k")


@_query(_with(*_PIPELINE, _ACTIONS, """
SELECT count(*) AS total, count(*) FILTER (status = 'OPEN') AS open, count(*) FILTER (status = 'ACKNOWLEDGED') AS acknowledged, count(*) FILTER (status = 'RESOLVED') AS resolved
FROM lifecycle"""))
def alert_stats(spark, d):
    found = stored(_alerts(spark, d).select("id", "created_at"))
    return incidents.stats(incidents.apply_actions(found, _actions(found)))


@_query(_with(*_PIPELINE, _ACTIONS, """
SELECT id, status, CASE WHEN id % 2 = 0 THEN CASE WHEN id % 4 = 0 THEN 'operator' ELSE 'anonymous' END END AS acknowledged_by,
  CASE WHEN id % 2 = 0 THEN created_at + INTERVAL 1 HOUR END AS acknowledged_at, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 9 = 0 THEN 'upstream' ELSE '' END END AS root_cause,
  CASE WHEN id % 3 = 0 THEN created_at + INTERVAL 2 HOUR END AS resolved_at
FROM lifecycle"""))
def alert_lifecycle(spark, d):
    found = stored(_alerts(spark, d).select("id", "created_at"))
    done = incidents.apply_actions(found, _actions(found))
    return done.select("id", "status", "acknowledged_by", "acknowledged_at", "root_cause", "resolved_at")


#: The columns of alerts that incidents are made of.
_OF_INCIDENTS = ("alert_type", "source", "event_type", "created_at")
_INCIDENTS = """
times AS (SELECT DISTINCT source, event_type, received_at AS moment FROM every_alert),
starts AS (
  SELECT source, event_type, min(moment) AS start FROM times GROUP BY ALL
  UNION ALL
  SELECT s.source, s.event_type, min(t.moment) FROM starts s JOIN times t USING (source, event_type) WHERE t.moment >= s.start + INTERVAL 6 HOUR GROUP BY s.source, s.event_type, s.start),
opened AS (SELECT DISTINCT source, event_type, start FROM starts),
grouped AS (
  SELECT o.source, o.event_type, o.start, count(*) AS alerts, min((a.received_at, a.alert_type)) AS first
  FROM opened o JOIN every_alert a ON a.source = o.source AND a.event_type = o.event_type AND a.received_at >= o.start AND a.received_at < o.start + INTERVAL 6 HOUR GROUP BY ALL)
"""


@_query("WITH RECURSIVE " + ",\n".join(p.strip() for p in (*_PIPELINE, _INCIDENTS)) + "\nSELECT first[2] || ' on ' || source AS title, source, event_type, start AS created_at, alerts FROM grouped")
def incident_correlation(spark, d):
    return reads.incidents_list(incidents.incidents(incidents.correlate(stored(_alerts(spark, d).select(*_OF_INCIDENTS)), SETTINGS.incident_window))).drop("status")


@_query("WITH RECURSIVE " + ",\n".join(p.strip() for p in (*_PIPELINE, _INCIDENTS)) + """
SELECT count(*) AS total, count(*) FILTER (epoch_us(start) // 1000000 % 2 = 1) AS open, 0::BIGINT AS acknowledged, count(*) FILTER (epoch_us(start) // 1000000 % 2 = 0) AS resolved FROM grouped""")
def incident_stats(spark, d):
    """Statistics of incidents of which those opened in an even second are resolved."""
    found = incidents.incidents(incidents.correlate(stored(_alerts(spark, d).select(*_OF_INCIDENTS)), SETTINGS.incident_window))
    even = F.floor(micros(F.col("created_at")) / 1_000_000) % 2 == 0
    return incidents.stats(found.withColumn("status", F.when(even, F.lit("RESOLVED")).otherwise(F.lit("OPEN"))))


#: SQL and Spark write the numbers in the messages of ranges differently.
_MESSAGE = "CASE WHEN alert_type <> 'FIELD_OUT_OF_RANGE' THEN message END AS message"


@_query(_with(*_PIPELINE, f"SELECT seq, alert_type, field_path, {_MESSAGE} FROM every_alert"))
def stream_pipeline_equivalence(spark, d):
    """The alerts of all detectors over the events as a stream of three batches, one by one."""
    store = stream_processed(events(spark, d), SETTINGS, now=_now(spark, d))
    found = store.read("quality_alerts").where("alert_type <> 'STALE_SOURCE'")
    return found.select(F.floor(F.col("id") / alerts.PLACES).alias("seq"), "alert_type", "field_path", F.expr(_MESSAGE))


def _alerts_by_event(store: Store) -> DataFrame:
    """Alerts with the id of their event, where numbers of arrival are the store's own."""
    found = store.read("quality_alerts").where("alert_type <> 'STALE_SOURCE'").withColumn("of", F.floor(F.col("id") / alerts.PLACES))
    of = store.read("raw_events").select(F.col("id").alias("of"), "event_id")
    return found.join(of, "of").select("event_id", "source", "alert_type", "field_path", F.expr(_MESSAGE))


_BY_EVENT = f"SELECT s.event_id, a.source, alert_type, field_path, {_MESSAGE} FROM every_alert a JOIN stream s USING (seq)"


@_query(_with(*_PIPELINE, _BY_EVENT))
def json_ingest_alerts(spark, d):
    """Alerts of events that are taken in from JSON lines, numbered by their place in the files."""
    store = Store(spark, new_folder(spark))
    write_json(events(spark, d), f"{store.folder}/input")
    ingest.ingest(store, read_events(spark, f"{store.folder}/input"), 0, SETTINGS, _now(spark, d))
    return _alerts_by_event(store)


@_query(_with(*_PIPELINE, _BY_EVENT))
def message_stream_alerts(spark, d):
    """Alerts of events that come as messages of a log with three partitions, in two micro-batches."""
    folder, rows = new_folder(spark), stored(events(spark, d))
    schema = "key string, value string, topic string, partition int, offset long, timestamp timestamp"
    for condition in cuts(rows, 2):
        some = rows.where(condition)
        place = [F.lit("raw-events").alias("topic"), F.pmod(F.xxhash64(envelope.partition_key()), F.lit(3)).cast("int").alias("partition"), F.col("seq").alias("offset")]
        at = F.col("received_at").cast("timestamp").alias("timestamp")
        some = some.select(*[F.col(c) for c in ("event_id", "source", "event_type", "event_timestamp", "payload")], *place, at)
        to_messages(some, "topic", "partition", "offset", "timestamp").write.mode("append").parquet(f"{folder}/log")
        # all that has come since the last start is one batch
        store = run(from_messages(spark.readStream.schema(schema).parquet(f"{folder}/log")), folder, SETTINGS, _now(spark, d))
    return _alerts_by_event(store)


def _in_batches(spark: SparkSession, d: str, batches: int = 3) -> Store:
    """The tables with all events taken in as batches, once for each session and state of the folder."""
    key = (spark.sparkContext.applicationId, f"{_state_of(spark, d)}#{batches}")
    if key not in _taken_in or not _taken_in[key].exists("batches"):
        rows, store = arrived(events(spark, d)), Store(spark, new_folder(spark))
        for part, condition in enumerate(cuts(rows, batches)):
            ingest.ingest(store, rows.where(condition), part, SETTINGS, _now(spark, d))
        _taken_in[key] = store
    return _taken_in[key]


@_query(_with(*_PIPELINE, """
SELECT alert_type, severity, source, event_type, count(*) AS n, count(DISTINCT seq) AS events FROM every_alert GROUP BY ALL"""))
def batch_ingest_alerts(spark, d):
    """Alerts by type and source of events that are taken in as three batches."""
    found = _in_batches(spark, d).read("quality_alerts").where("alert_type <> 'STALE_SOURCE'").withColumn("seq", F.floor(F.col("id") / alerts.PLACES))
    return found.groupBy("alert_type", "severity", "source", "event_type").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("events"))


@_query(_with(EVENTS_SQL, _SCHEMAS, "SELECT * FROM versions"))
def batch_ingest_versions(spark, d):
    return _local(ingest.current_versions(_in_batches(spark, d))).drop("schema_json")


@_query(_with(EVENTS_SQL, _SCHEMAS, _NULLS, _METRICS, "SELECT * FROM metrics_long"))
def batch_ingest_metrics(spark, d):
    return _local(ingest.current_metrics(_in_batches(spark, d), SETTINGS))


@_query("WITH RECURSIVE " + ",\n".join(p.strip() for p in (*_PIPELINE, _INCIDENTS)) + "\nSELECT first[2] || ' on ' || source AS title, source, event_type, start AS created_at, alerts FROM grouped")
def batch_ingest_incidents(spark, d):
    """Incidents of alerts that are taken in as three batches; open ones go on from batch to batch."""
    return _local(ingest.current_incidents(_in_batches(spark, d))).select("title", "source", "event_type", "created_at", "alerts")


@_query(_with(*_PIPELINE, "SELECT (SELECT count(*) FROM stream) AS events_ingested, (SELECT count(*) FROM every_alert) AS alerts_fired"))
def ingest_counters(spark, d):
    return ingest.counters(tables(spark, d))


@_query(_with(*_PIPELINE, "SELECT seq, source, alert_type, field_path, message FROM every_alert WHERE alert_type IN ('DUPLICATE_EVENT', 'NULL_SPIKE', 'ANOMALY_SPIKE')"))
def keyed_state_alerts(spark, d):
    """Alerts of the detectors that look back, from keyed state over a stream of three batches with restarts."""
    return streamed_alerts(events(spark, d), SETTINGS).select("seq", "source", "alert_type", "field_path", "message")


@_query(_with(EVENTS_SQL, _SCHEMAS, _NULLS, _METRICS, "SELECT * FROM metrics_long"))
def stream_metric_windows(spark, d):
    """Metrics from a stream with a watermark: final windows, and what came late or is open yet, as one table."""
    done = streamed_windows(events(spark, d), SETTINGS, "1 hour")
    sums = done.groupBy("source", "event_type", "window_start", "field_path").agg(F.sum("total").alias("total"), F.sum("nulls").alias("nulls"))
    return metrics.from_sums(sums, SETTINGS)
