"""The detection pipeline on a stream: each micro-batch is taken in as a part of the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.config import Settings
from plumbline.plans.ingest import ingest
from plumbline.sources.store import Store, new_folder, stored


def start(stream: DataFrame, folder: str, settings: Settings, every: str | None = None, now: Column | None = None) -> tuple[Store, StreamingQuery]:
    """Start to process the stream: all that it has now, or on and on with a batch `every` so often ('1 second').

    Batches fill all tables as plans.ingest does, and what the detectors remember is in the tables too; so a
    batch that runs again replaces what it wrote, and a later start with the same folder goes on from where
    this one ends. now: the clock of the sources' health, by default the time at which a batch runs.
    """
    store = Store(stream.sparkSession, f"{folder}/tables")
    clock = F.current_timestamp() if now is None else now
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return store, writer.foreachBatch(lambda batch, number: ingest(store, batch, number, settings, clock) and None).start()


def run(stream: DataFrame, folder: str, settings: Settings, now: Column | None = None) -> Store:
    """Process all that the stream has now, and wait for it."""
    store, query = start(stream, folder, settings, now=now)
    query.awaitTermination()
    return store


def cuts(events: DataFrame, batches: int) -> list[Column]:
    """Conditions that part events by even stretches of their arrival, in order."""
    ends = events.agg(F.min("received_at").alias("a"), F.max("received_at").alias("b")).first()
    kind = events.schema["received_at"].dataType
    if ends["a"] is None:
        return [F.lit(True)]
    starts = [ends["a"] + (ends["b"] - ends["a"]) * k / batches for k in range(batches)]
    parts = [F.col("received_at") >= F.lit(s).cast(kind) for s in starts]
    return [a & (F.col("received_at") < F.lit(s).cast(kind)) for a, s in zip(parts, starts[1:], strict=False)] + parts[-1:]


def arrived(events: DataFrame) -> DataFrame:
    """The events stored in stretches of their arrival, so that a reader of a part of it opens that part of the files."""
    return stored(events.repartitionByRange("received_at"))


def land(events: DataFrame, folder: str) -> None:
    """Append events with seq to a folder that a stream reads, in files for all cores however few the input has."""
    events.repartition("seq").write.mode("append").parquet(folder)


def stream_processed(events: DataFrame, settings: Settings, batches: int = 3, now: Column | None = None) -> Store:
    """Events written to a folder for each stretch of their arrival, streamed batch by batch: the tables that they fill."""
    spark, folder = events.sparkSession, new_folder(events.sparkSession)
    store, rows = None, stored(events)  # the source is read once
    for part in cuts(rows, batches):
        land(rows.where(part), f"{folder}/input")
        # all that has come since the last start is one batch
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/input")
        store = run(stream, folder, settings, now)
    return store
