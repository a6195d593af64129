"""The driver tables as a stream of events with late, repeated, drifting and null-heavy parts, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import HOUR, Bounds, Settings

#: The events are sparse (a few an hour and type), so that windows are longer and ratios lower here.
SETTINGS = Settings(
    window_size=6 * HOUR, null_threshold=0.5, anomaly_ratio=1.5, anomaly_min_count=3, ranges={"v": Bounds(0, 15000)}, incident_window=6 * HOUR
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope with seq and received_at.

    By event number i: every 97th is 10 minutes late and every 997th two hours; every 50th comes again a
    minute later, and the payload of every 75th under a new id two minutes later. The payload has k, which
    is missing for every 211th and mostly null on every fifth day, v, which is a string for every 101st,
    and an object w for every 307th.
    """
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("i"),
        F.col("ts").alias("event_timestamp"),
        "event_type",
        F.floor(F.col("value") * 100).cast("string").alias("v"),
        F.get_json_object("props", "$.k").alias("k"),
        (F.col("user_id") % 10).alias("u"),
        F.dayofmonth("ts").alias("d"),
    )
    i = F.col("i")
    k = F.when(i % 211 == 0, F.lit(None)).when((F.col("d") % 5 == 0) & (i % 7 < 5), F.lit('"k":null')).otherwise(F.concat(F.lit('"k":'), "k"))
    v = F.when(i % 101 == 0, F.concat(F.lit('"v":"'), "v", F.lit('"'))).otherwise(F.concat(F.lit('"v":'), "v"))
    w = F.when(i % 307 == 0, F.lit('"w":{"x":1,"y":true}'))
    late = F.when(i % 997 == 0, F.lit(7200)).when(i % 97 == 0, F.lit(600)).otherwise(F.lit(1)).cast("long")
    source = (
        F.when(F.col("u") == 0, F.lit("coindesk"))
        .when(F.col("u") == 1, F.lit("rss-1"))
        .when(F.col("u") == 2, F.lit("pipeline-2"))
        .when(F.col("u") == 3, F.lit("sourcehero"))
        .otherwise(F.concat(F.lit("user-"), F.col("u").cast("string")))
    )
    # one pass over the table: each event, and its replays by number
    copies = F.filter(F.array(F.lit(0), F.when(i % 50 == 0, F.lit(1)), F.when(i % 75 == 0, F.lit(2))), lambda c: c.isNotNull())
    spread = raw.select("*", F.explode(copies).alias("copy"))
    wait = late + F.col("copy") * 60
    return spread.select(
        (i * 4 + F.col("copy")).alias("seq"),
        F.concat(F.when(F.col("copy") == 2, F.lit("rep-")).otherwise(F.lit("evt-")), i.cast("string")).alias("event_id"),
        source.alias("source"),
        "event_type",
        "event_timestamp",
        F.timestamp_add("SECOND", wait, F.col("event_timestamp")).alias("received_at"),
        F.concat(F.lit("{"), F.concat_ws(",", k, v, w), F.lit("}")).alias("payload"),
    )


#: The same in SQL, as common table expressions that end in `stream`.
EVENTS_SQL = """
raw AS (
  SELECT event_id AS i, ts AS event_timestamp, event_type, CAST(floor(value * 100) AS BIGINT)::VARCHAR AS v,
    json_extract_string(props, '$.k') AS k, user_id % 10 AS u, day(ts) AS d
  FROM events),
shaped AS (
  SELECT i, event_timestamp, event_type,
    CASE u WHEN 0 THEN 'coindesk' WHEN 1 THEN 'rss-1' WHEN 2 THEN 'pipeline-2' WHEN 3 THEN 'sourcehero' ELSE 'user-' || u END AS source,
    CASE WHEN i % 997 = 0 THEN 7200 WHEN i % 97 = 0 THEN 600 ELSE 1 END AS late,
    CASE WHEN i % 211 = 0 THEN 'absent' WHEN d % 5 = 0 AND i % 7 < 5 THEN 'null' ELSE 'number' END AS k_is, i % 101 = 0 AS v_text, i % 307 = 0 AS has_w,
    '{' || concat_ws(',',
      CASE WHEN i % 211 = 0 THEN NULL WHEN d % 5 = 0 AND i % 7 < 5 THEN '"k":null' ELSE '"k":' || k END,
      CASE WHEN i % 101 = 0 THEN '"v":"' || v || '"' ELSE '"v":' || v END,
      CASE WHEN i % 307 = 0 THEN '"w":{"x":1,"y":true}' END) || '}' AS payload,
    v::DOUBLE AS v_number
  FROM raw),
stream AS (
  SELECT i * 4 + c AS seq, CASE WHEN c = 2 THEN 'rep-' ELSE 'evt-' END || i AS event_id, source, event_type, event_timestamp,
    event_timestamp + to_seconds(late + c * 60) AS received_at, payload, sha256(payload) AS payload_hash, k_is, v_text, has_w, v_number
  FROM shaped, (SELECT unnest([0, 1, 2]) AS c)
  WHERE c = 0 OR (c = 1 AND i % 50 = 0) OR (c = 2 AND i % 75 = 0))
"""
