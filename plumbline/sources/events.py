"""Readers and writers of events: JSON lines, Parquet, and messages of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import model
from plumbline.operators.envelope import partition_key
from plumbline.sources.arrival import file_origin, message_origin

#: The form in which times are written; readers take any number of digits.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def read_events(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Events of JSON lines (the payload stays JSON text) or Parquet files, with their origin; Parquet may bring seq.

    JSON may bring received_at, the time at which a gateway took the event; else it is the time of the file. Lines that
    are no JSON become rows without values, which validation rejects.
    """
    return _placed(spark.read.schema(_schema(form)).format(form).load(path), form)


def stream_events(spark: SparkSession, path: str, form: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream of the files that come."""
    return _placed(spark.readStream.schema(_schema(form)).option("maxFilesPerTrigger", files_per_trigger).format(form).load(path), form)


def _schema(form: str) -> str:
    return f"{model.EVENT}, {model.ARRIVAL}" if form == "parquet" else f"{model.EVENT}, received_at timestamp"


def _placed(rows: DataFrame, form: str) -> DataFrame:
    """Parquet events bring seq, others their origin."""
    return rows if form == "parquet" else rows.select("*", file_origin().alias("origin"))


def write_json(events: DataFrame, path: str) -> None:
    """Events as JSON lines with received_at, files and lines in order of arrival."""
    body = F.struct(
        "event_id", "source", "event_type", F.col("event_timestamp").cast("timestamp").alias("event_timestamp"),
        F.col("received_at").cast("timestamp").alias("received_at"), F.try_parse_json("payload").alias("payload"),
    )
    # a time is in one file, so that files need no order among them
    rows = events.repartitionByRange("received_at").sortWithinPartitions("received_at", "seq")
    rows.select(F.to_json(body, _TIMES).alias("value")).write.mode("append").text(path)


def from_messages(messages: DataFrame) -> DataFrame:
    """Events of messages as a log gives them: value (JSON), topic, partition, offset and timestamp."""
    rows = messages.select(
        F.from_json(F.col("value").cast("string"), model.EVENT).alias("e"), F.col("timestamp").alias("received_at"), message_origin().alias("origin")
    )
    return rows.select("e.*", "received_at", "origin")


def stream_kafka(spark: SparkSession, servers: str, topic: str = "raw-events") -> DataFrame:
    """Events from a Kafka topic; needs Spark's Kafka connector on the class path."""
    return from_messages(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load())


def to_messages(events: DataFrame, *kept: str) -> DataFrame:
    """(key, value) of a message for each event, its source and type, and its JSON; and the columns to keep."""
    at = F.col("event_timestamp").cast("timestamp").alias("event_timestamp")
    body = F.to_json(F.struct("event_id", "source", "event_type", at, F.try_parse_json("payload").alias("payload")), _TIMES)
    return events.select(partition_key().alias("key"), body.alias("value"), *kept)


def write_kafka(events: DataFrame, servers: str, topic: str = "raw-events") -> None:
    """Publish a batch of events; needs Spark's Kafka connector on the class path."""
    to_messages(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
