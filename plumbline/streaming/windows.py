"""Metrics of event-time windows on a stream: each window is final once, behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.config import Settings
from plumbline.operators import metrics, schemas
from plumbline.operators.envelope import enrich
from plumbline.sources.store import new_folder, stored
from plumbline.streaming.replay import cuts, land


def final_sums(stream: DataFrame, settings: Settings, baselines: DataFrame, delay: str) -> DataFrame:
    """metrics.window_sums() of a stream of events in append mode: the windows that an event within `delay` cannot reach any more.

    baselines: schemas.baselines() of the types, as a table. State holds the windows of the delay.
    """
    return metrics.streamed_sums(schemas.shaped(enrich(stream)), settings, delay, lambda rows: schemas.with_baseline(schemas.walked(rows), baselines))


def streamed_windows(events: DataFrame, settings: Settings, delay: str, batches: int = 3) -> DataFrame:
    """metrics.settled() of events that come in stretches of their arrival, with a restart after each."""
    spark, folder = events.sparkSession, new_folder(events.sparkSession)
    described = schemas.describe(enrich(events).drop("payload_hash"))
    baselines = stored(schemas.baselines(described.kinds))
    arrived = described.events.select(*events.columns)  # the source is read once
    for part in cuts(arrived, batches):
        land(arrived.where(part), f"{folder}/input")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/input")
        writer = final_sums(stream, settings, baselines, delay).writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        writer.option("path", f"{folder}/final").format("parquet").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    sums = stored(metrics.window_sums(described.with_baseline(baselines), settings))
    final = spark.read.schema("source string, event_type string, window_start timestamp, field_path string, total double, nulls double").parquet(f"{folder}/final")
    return metrics.settled(final.withColumn("window_start", final["window_start"].cast(sums.schema["window_start"].dataType)), sums)
