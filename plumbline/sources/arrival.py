"""Numbers of arrival (seq) from where an event stands in its source, so that they are the same however often it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.store import stored

#: Where an event stands: when its block came, the file or topic, the split of the file or the partition of the topic,
#: and the place in it; a null place is the order in which the block is read.
ORIGIN = "struct<came_at:timestamp,name:string,block:long,place:long>"


def file_origin() -> Column:
    """Of rows of a file source, in batches and streams."""
    of = lambda c: F.col(f"_metadata.{c}")
    found = F.struct(of("file_modification_time").alias("came_at"), of("file_path").alias("name"), of("file_block_start").alias("block"), F.lit(None).alias("place"))
    return found.cast(ORIGIN)


def message_origin() -> Column:
    """Of rows with a message log's topic, partition and offset."""
    found = F.struct(F.lit(None).alias("came_at"), F.col("topic").alias("name"), F.col("partition").alias("block"), F.col("offset").alias("place"))
    return found.cast(ORIGIN)


def numbered(events: DataFrame, base: int = 0) -> tuple[DataFrame, int]:
    """(events with seq instead of origin, the numbers used); events that bring seq stay as they are and use none.

    Blocks come one after the other: files by time of change, name and split, partitions of a topic by name and number.
    In a block events are numbered from its first one on, so numbers do not depend on how files are split, and the same
    files or offsets get the same numbers again. base: the numbers used before. received_at is filled from the time of
    the file, or with the time now, where events do not bring it. Only a row for each block goes through one task.

    Events without an origin are numbered in the order in which the frame is read, which is as stable as that is.
    """
    if "seq" in events.columns:
        return events, 0
    origin = F.col("origin") if "origin" in events.columns else F.lit(None).cast(ORIGIN)
    block = F.coalesce(origin["block"], F.spark_partition_id().cast("long"))
    place = F.coalesce(origin["place"], F.monotonically_increasing_id())
    came = F.col("received_at") if "received_at" in events.columns else F.lit(None).cast("timestamp")
    kept = [F.col(f"`{c}`") for c in events.columns if c not in ("origin", "received_at")]
    at = [origin["came_at"].alias("__came"), origin["name"].alias("__name"), block.alias("__block"), place.alias("__place")]
    # written once: the order in which a block is read is a number only as it is read
    rows = stored(events.select(*kept, F.coalesce(came, origin["came_at"].cast(came_type(events)), F.current_timestamp().cast(came_type(events))).alias("received_at"), *at))
    blocks = rows.groupBy("__came", "__name", "__block").agg(F.min("__place").alias("__first"), (F.max("__place") - F.min("__place") + 1).alias("__span"))
    order = Window.orderBy("__came", "__name", "__block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("__upto", F.sum("__span").over(order)).toDF("of_came", "of_name", "of_block", "__first", "__span", "__upto")
    blocks = stored(blocks)
    used = blocks.agg(F.max("__upto")).first()[0] or 0
    same = F.col("__came").eqNullSafe(F.col("of_came")) & F.col("__name").eqNullSafe(F.col("of_name")) & (F.col("__block") == F.col("of_block"))
    seq = F.lit(base) + F.col("__upto") - F.col("__span") + F.col("__place") - F.col("__first")
    return rows.join(blocks, same).select(*kept, "received_at", seq.alias("seq")), used


def came_type(events: DataFrame) -> str:
    return events.schema["received_at"].dataType.simpleString() if "received_at" in events.columns else "timestamp"
