"""Repeated event ids and repeated payloads within a window of arrival time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import Settings, iso_duration
from plumbline.functions.timing import micros, to_micros
from plumbline.operators.alerts import alert, where


def repeated_ids(events: DataFrame, window: float) -> DataFrame:
    """Add repeated_id: whether the same event_id arrived before, at most `window` seconds ago.

    The row just before tells, so no frame is kept; rows are spread by event_id.
    """
    order = Window.partitionBy("event_id").orderBy("received_at", "seq")
    gap = micros(F.col("received_at")) - micros(F.lag("received_at").over(order))
    return events.withColumn("repeated_id", F.coalesce(gap <= to_micros(window), F.lit(False)))


def first_of_payload(events: DataFrame, window: float, key: str = "payload_hash") -> DataFrame:
    """Add first_event_id: of the earliest row with the same payload that arrived at most `window` seconds ago.

    Null where no other row came before. Rows at the same time count in order of seq: a row looks at those
    before it only. Arrival is cut into stretches of the window, and each row goes to its own and, with its
    place alone, to the one after, where it counts until the window has passed; so running minima do, and
    a payload of very many rows is spread over its stretches.
    """
    size = to_micros(window)
    kept = [c for c in events.columns if c != key]
    spread = events.withColumn("__at", micros(F.col("received_at"))).withColumn("__place", F.struct("__at", "seq", "event_id"))
    spread = spread.withColumn("__carried", F.explode(F.array(F.lit(False), F.lit(True))))
    stretch = F.floor(F.col("__at") / size)
    spread = spread.select(
        key, "__place", "__carried",
        *[F.when(~F.col("__carried"), F.col(f"`{c}`")).alias(c) for c in kept],
        F.when(F.col("__carried"), stretch + 1).otherwise(stretch).alias("__stretch"),
        F.when(F.col("__carried"), F.col("__at") + size).otherwise(F.col("__at")).alias("__until"),
    )
    own = Window.partitionBy(key, "__stretch").orderBy(F.desc("__until"), F.desc("__carried"))
    so_far, whole = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.min(F.when(F.col("__carried"), F.col("__place"))).over(so_far)
    here = F.min(F.when(~F.col("__carried"), F.col("__place"))).over(whole)
    rows = spread.select("*", before.alias("__before"), here.alias("__here")).where("NOT __carried")
    first = F.coalesce("__before", "__here")
    found = F.when(first < F.col("__place"), first["event_id"])
    return rows.withColumn("first_event_id", found).select(*events.columns, "first_event_id")


def payload_matches(events: DataFrame, payload_hash: str, after: Column, event_id: str) -> DataFrame:
    """The first event with a payload that came after a time under another id, if there is one."""
    other = (F.col("payload_hash") == payload_hash) & (F.col("received_at") > after) & (F.col("event_id") != event_id)
    return events.where(other).orderBy("received_at", "seq").limit(1)


def id_alert() -> Column:
    """The alert of an event whose id came before."""
    evidence = F.struct(F.lit("REPEATED_EVENT_ID").alias("duplicate_kind"), F.col("event_id"), F.col("source"))
    return alert("DUPLICATE_EVENT", "INFO", F.concat(F.lit("Repeated event_id "), F.col("event_id")), evidence)


def payload_alert(settings: Settings) -> Column:
    """The alert of an event whose payload came with first_event_id before."""
    window = iso_duration(settings.duplicate_window)
    evidence = F.struct(
        F.lit("REPEATED_PAYLOAD").alias("duplicate_kind"),
        F.col("payload_hash"),
        F.lit(window).alias("window"),
        F.col("event_id").alias("current_event_id"),
        F.col("first_event_id"),
    )
    message = F.concat(F.lit(f"Repeated payload hash within {window}; first event_id="), F.col("first_event_id"))
    return alert("DUPLICATE_EVENT", "INFO", message, evidence)


def found(events: DataFrame, settings: Settings, recent: DataFrame | None = None) -> list[DataFrame]:
    """The repeats among events: (seq, repeated_id) of repeated ids, and (seq, first_event_id) of payloads of another event.

    Only ids, times and hashes are moved; the events that repeat nothing are left out.

    recent: (seq, event_id, received_at, payload_hash) of the events of the window before these, which came first:
    batches are to come in order of arrival. An event that came before those of an earlier batch is compared with
    them by time, but does not change what was found there.
    """
    columns = ["seq", "event_id", "received_at", F.unhex("payload_hash").alias("payload_hash")]
    held = events.select(*columns, F.lit(False).alias("__recent"))
    if recent is not None:
        held = held.unionByName(recent.select(*columns, F.lit(True).alias("__recent")))
    ids = repeated_ids(held.drop("payload_hash"), settings.duplicate_window).where("repeated_id AND NOT __recent")
    payloads = first_of_payload(held, settings.duplicate_window).where("first_event_id <> event_id AND NOT __recent")
    return [ids.select("seq", "repeated_id"), payloads.select("seq", "first_event_id")]


def detected(settings: Settings) -> list[Column]:
    """Arrays with the alerts of events that found() has been joined to: of the id, then of the payload of another event."""
    return [where(F.col("repeated_id"), id_alert()), where(F.col("first_event_id").isNotNull(), payload_alert(settings))]
