"""Spikes of nulls and of event counts: alerts at the event that crosses the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import Settings
from plumbline.functions.ordered import islands
from plumbline.functions.timing import iso_instant, micros, plus, to_micros, window_start
from plumbline.operators.alerts import alert, no_alerts

#: Rows that stand for earlier batches come before all events.
_ORDER = ["new", "received_at", "seq"]
_KEYS = ["source", "event_type"]


def null_runs(observed: DataFrame, settings: Settings, before: DataFrame | None = None) -> DataFrame:
    """Events with a baseline, numbered by runs of one window: island, total_count (events of the run so far) and
    nulls, an array of the fields that are null (field_path, n = 1).

    Events of a source and type count in order of arrival, anew whenever their window changes; late events of
    an older window start anew too. before: null_state() after earlier batches, whose rows come first (new = 0).
    """
    long_ = lambda n: F.lit(n).cast("long")
    rows = observed.where("size(leaves) > 0").select(
        F.lit(1).alias("new"), "seq", "received_at", *_KEYS, window_start(F.col("event_timestamp"), settings.window_size).alias("window_start"),
        long_(1).alias("weight"), F.transform("empty", lambda path: F.struct(path.alias("field_path"), long_(1).alias("n"))).alias("nulls"),
    )
    chunk = F.floor(micros(F.col("received_at")) / to_micros(settings.order_chunk))
    if before is not None:
        own = before.select(
            F.lit(0).alias("new"), long_(0).alias("seq"), F.lit(None).cast(observed.schema["received_at"].dataType).alias("received_at"), *_KEYS,
            "window_start", F.col("total").alias("weight"), "nulls",
        )
        rows = rows.unionByName(own)
        chunk = F.coalesce(chunk, F.lit(-(1 << 62)))
    numbered = islands(rows, _KEYS, _ORDER, "window_start", chunk)
    running = Window.partitionBy(*_KEYS, "island").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("total_count", F.sum("weight").over(running)).drop("weight")


def null_state(runs: DataFrame) -> DataFrame:
    """(source, event_type, window_start, total, nulls): the last run of each key and its nulls by field."""
    last = runs.groupBy(*_KEYS).agg(F.max_by(F.struct("island", "window_start", "total_count"), F.struct(*_ORDER)).alias("l"))
    last = last.select(*[F.col(k).alias(f"of_{k}") for k in _KEYS], "l.island", "l.window_start", "l.total_count")
    same = F.col("source").eqNullSafe(F.col("of_source")) & F.col("event_type").eqNullSafe(F.col("of_event_type"))
    rows = runs.select(*_KEYS, F.col("island").alias("own_island"), F.explode_outer("nulls").alias("e"))
    counted = rows.join(last, same & (F.col("own_island") == F.col("island"))).groupBy(*_KEYS, "window_start", "total_count", "e.field_path").agg(F.sum("e.n").alias("n"))
    # a row for each field of a type
    nulls = F.filter(F.collect_list(F.struct("field_path", "n")), lambda e: e["field_path"].isNotNull())
    return counted.groupBy(*_KEYS, "window_start", F.col("total_count").alias("total")).agg(nulls.alias("nulls"))


def null_spikes(runs: DataFrame, settings: Settings) -> DataFrame:
    """The events and fields at which the rate of nulls rises above the threshold, from null_runs().

    A rate rises at nulls only, so nothing but these is spread by field: what a null adds is its number among
    those of its run. Adds field_path, null_count and null_rate.
    """
    nulls = runs.select("*", F.inline("nulls")).drop("nulls")
    running = Window.partitionBy(*_KEYS, "field_path", "island").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    counted = nulls.withColumn("null_count", F.sum("n").over(running)).where("new = 1")
    total, count = F.col("total_count"), F.col("null_count")
    before = F.when(total > 1, (count - 1) / F.greatest(total - 1, F.lit(1))).otherwise(F.lit(0.0))
    crossing = (total >= settings.null_min_samples) & (before <= settings.null_threshold) & (count / total > settings.null_threshold)
    return counted.where(crossing).withColumn("null_rate", count / total).drop("island", "n", "new")


def null_alert(settings: Settings) -> Column:
    """The alert of a row of null_spikes()."""
    end = plus(F.col("window_start"), settings.window_size)
    evidence = F.struct(
        "field_path", iso_instant(F.col("window_start")).alias("window_start"), iso_instant(end).alias("window_end"), "null_count",
        "total_count", "null_rate", F.lit(settings.null_threshold).alias("threshold"),
    )
    message = F.concat(
        F.lit("Null spike for "), F.col("field_path"), F.lit(" in "), F.col("event_type"), F.lit(" ("), F.col("null_count").cast("string"),
        F.lit("/"), F.col("total_count").cast("string"), F.lit(")"),
    )
    return alert("NULL_SPIKE", "WARN", message, evidence, F.col("field_path"))


def _null_alerts(spikes: DataFrame, settings: Settings) -> DataFrame:
    return spikes.select("seq", null_alert(settings).alias("a")).groupBy("seq").agg(F.array_sort(F.collect_list("a")).alias("null_alerts"))


def window_counts(events: DataFrame, size: float) -> DataFrame:
    """(source, event_type, window_start, events)."""
    start = window_start(F.col("event_timestamp"), size).alias("window_start")
    return events.groupBy("source", "event_type", start).agg(F.count("*").alias("events"))


def baselines(counts: DataFrame, settings: Settings) -> DataFrame:
    """Add history (windows with events among the N before) and baseline (their mean count)."""
    size = to_micros(settings.window_size)
    at = Window.partitionBy("source", "event_type").orderBy("__at").rangeBetween(-settings.anomaly_windows * size, -1)
    df = counts.withColumn("__at", micros(F.col("window_start")))
    return df.withColumn("history", F.count("*").over(at)).withColumn("baseline", F.avg("events").over(at)).drop("__at")


def _candidates(events: DataFrame, settings: Settings) -> DataFrame:
    """(source, event_type, window_start) of the windows in which a crossing is possible.

    Where all events of the windows before came before the first of a window, its baseline is their mean; where
    some came later it was lower for a while, so that the window is looked at in any case.
    """
    windows = events.groupBy(*_KEYS, "window_start").agg(
        F.sum("weight").alias("events"), F.min(F.struct(*_ORDER)).alias("first"), F.max(F.struct(*_ORDER)).alias("last")
    )
    size = to_micros(settings.window_size)
    at = Window.partitionBy(*_KEYS).orderBy("__at").rangeBetween(-settings.anomaly_windows * size, -1)
    known = windows.withColumn("__at", micros(F.col("window_start")))
    known = known.withColumn("history", F.count("*").over(at)).withColumn("baseline", F.avg("events").over(at)).withColumn("before", F.max("last").over(at))
    enough = (F.col("history") >= settings.anomaly_min_history) & (F.col("events") >= settings.anomaly_min_count)
    least = F.when(F.col("before") < F.col("first"), F.col("baseline")).otherwise(F.lit(1.0))
    return known.where(enough & (F.col("events") > least * settings.anomaly_ratio)).select(*_KEYS, "window_start")


def anomaly_spikes(events: DataFrame, settings: Settings, before: DataFrame | None = None) -> DataFrame:
    """The events at which a window's count rises above ratio times its baseline.

    The baseline is the mean of those of the N windows before that have events, as they are when the event
    arrives. before: window_counts() of earlier batches. Adds window_start, events_so_far, baseline, ratio, history.
    """
    size, n = settings.window_size, settings.anomaly_windows
    rows = events.select(F.lit(1).alias("new"), "seq", "received_at", *_KEYS, window_start(F.col("event_timestamp"), size).alias("window_start"), F.lit(1).cast("long").alias("weight"))
    if before is not None:
        none = F.lit(None).cast(events.schema["received_at"].dataType).alias("received_at")
        rows = rows.unionByName(before.select(F.lit(0).alias("new"), F.lit(0).cast("long").alias("seq"), none, *_KEYS, "window_start", F.col("events").alias("weight")))
    # an event counts in its own window and in the N after it, whose history it is
    spread = rows.withColumn("back", F.explode(F.array(*[F.lit(k) for k in range(n + 1)])))
    target = F.timestamp_add("MICROSECOND", F.col("back") * F.lit(to_micros(size)), F.col("window_start"))
    spread = spread.withColumn("window_start", target)
    wanted = _candidates(rows, settings).toDF("of_source", "of_type", "of_window")
    same = F.col("source").eqNullSafe(F.col("of_source")) & F.col("event_type").eqNullSafe(F.col("of_type"))
    joined = spread.join(wanted, same & (F.col("window_start") == F.col("of_window"))).drop("of_source", "of_type", "of_window")
    so_far = Window.partitionBy(*_KEYS, "window_start").orderBy(*_ORDER, "back").rowsBetween(Window.unboundedPreceding, 0)
    counts = [F.sum(F.when(F.col("back") == k, F.col("weight")).otherwise(F.lit(0))).over(so_far).alias(f"n{k}") for k in range(n + 1)]
    own = joined.select("*", *counts).where("back = 0 AND new = 1")
    earlier = F.array(*[F.col(f"n{k}") for k in range(1, n + 1)])
    own = own.withColumn("history", F.size(F.filter(earlier, lambda c: c > 0)).cast("long"))
    own = own.withColumn("baseline", F.aggregate(earlier, F.lit(0).cast("long"), lambda a, c: a + c) / F.nullif(F.col("history"), F.lit(0)))
    df = own.withColumn("events_so_far", F.col("n0")).withColumn("ratio", F.col("events_so_far") / F.col("baseline"))
    last = (F.col("events_so_far") - 1) / F.col("baseline")
    enough = (F.col("history") >= settings.anomaly_min_history) & (F.col("events_so_far") >= settings.anomaly_min_count)
    found = df.where(enough & (last <= settings.anomaly_ratio) & (F.col("ratio") > settings.anomaly_ratio))
    return found.drop("new", "weight", "back", *[f"n{k}" for k in range(n + 1)])


def anomaly_alert(settings: Settings) -> Column:
    """The alert of a row of anomaly_spikes()."""
    end = plus(F.col("window_start"), settings.window_size)
    evidence = F.struct(
        iso_instant(F.col("window_start")).alias("window_start"), iso_instant(end).alias("window_end"), "baseline",
        F.col("events_so_far").alias("current_value"), "ratio", F.lit(settings.anomaly_ratio).alias("threshold"),
        F.col("history").alias("history_windows"),
    )
    message = F.concat(
        F.lit("Anomaly spike in "), F.col("event_type"), F.lit(" window ("), F.col("events_so_far").cast("string"),
        F.lit(" vs baseline "), F.format_string("%.2f", "baseline"), F.lit(")"),
    )
    return alert("ANOMALY_SPIKE", "WARN", message, evidence)


def _anomaly_alerts(spikes: DataFrame, settings: Settings) -> DataFrame:
    return spikes.select("seq", F.array(anomaly_alert(settings)).alias("anomaly_alerts"))


def found(observed: DataFrame, settings: Settings, runs: DataFrame | None = None, counts: DataFrame | None = None) -> list[DataFrame]:
    """(seq, null_alerts) and (seq, anomaly_alerts) of the events with spikes. seq must tell events apart.

    runs: null_runs() of observed, if they are known already; counts: window_counts() of earlier batches.
    """
    nulls = _null_alerts(null_spikes(null_runs(observed, settings) if runs is None else runs, settings), settings)
    return [nulls, _anomaly_alerts(anomaly_spikes(observed, settings, counts), settings)]


def detected() -> list[Column]:
    """Arrays with the alerts of events that found() has been joined to: null spikes by field, then anomalies."""
    return [F.coalesce(c, no_alerts()) for c in ("null_alerts", "anomaly_alerts")]
