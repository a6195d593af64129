"""Detectors that look back, on a stream with keyed state: what they remember is bounded and survives a restart.

Each detector is a StatefulProcessor. Rows of a key are put in order of arrival within a micro-batch, so what a task
holds is what a trigger takes in. State is read once for a key and batch and written once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plumbline.config import Settings
from plumbline.functions import payload as P
from plumbline.functions.timing import MICROS, iso_instant, micros, to_micros, window_start
from plumbline.operators import duplicates, health, schemas, spikes
from plumbline.operators.alerts import alert
from plumbline.operators.envelope import enrich
from plumbline.sources.store import new_folder, stored
from plumbline.streaming.replay import cuts, land

#: Ids and payloads are spread over so many keys, each with a map that is pruned by the time of arrival. A number that
#: must stay the same while a stream goes on.
BUCKETS = 128
#: What is kept beyond the window of repeats.
GRACE = 60.0

_EVENT = ["seq", "source", "event_type", "event_id", "payload_hash"]
_EVENT_KIND = "seq long, source string, event_type string, event_id string, payload_hash string"

_PARTITIONS = "spark.sql.shuffle.partitions"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable", ignore_index=True)


def _found(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows, if there are any: of a frame without rows Arrow makes columns that Spark does not take."""
    if len(rows):
        yield rows


class _Pruned(StatefulProcessor):
    """A map whose entries go once their time is past: looked through once a window of arrival time.

    Entries are read only for rows that an earlier batch can reach, and written only if a later one can reach them; so a
    batch that is longer than the window costs calls to the state at its ends alone.
    """

    def __init__(self, window: float):
        self.window, self.kept = to_micros(window), to_micros(window + GRACE)

    def _init(self, handle: StatefulProcessorHandle, key: str, value: str) -> None:
        self.entries = handle.getMapState("entries", key, value)
        self.clock = handle.getValueState("clock", "next_look long, latest long")

    def _reach(self) -> int | None:
        """The last time at which a row can have one of an earlier batch in its window; None: there was no batch."""
        return self.clock.get()[1] + self.window if self.clock.exists() else None

    def _oldest(self, now: int) -> int:
        """What was last used before is not kept after a batch that ends now."""
        return (max(now, self.clock.get()[1]) if self.clock.exists() else now) - self.kept

    def _prune(self, now: int) -> None:
        if not self.clock.exists():
            self.clock.update((now + self.window, now))
            return
        next_look, latest = self.clock.get()
        if now >= next_look:
            # one value of an entry is the time at which it was last used, and comes first
            for key in [k for k, value in self.entries.iterator() if value[0] < now - self.kept]:
                self.entries.removeKey(key)
            next_look = now + self.window
        self.clock.update((next_look, max(now, latest)))

    def close(self) -> None:
        pass


class RepeatedIds(_Pruned):
    """Events whose id came before, at most a window ago. Input and output: bucket, seq, at and columns of the event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._init(handle, "event_id string", "last_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = _in_order(rows)
        before = df.groupby("event_id")["at"].shift().astype("Int64")
        last = df.groupby("event_id")["at"].max()
        now, reach = int(df["at"].max()), self._reach()
        if reach is not None:
            for row, name in df.drop_duplicates("event_id").loc[lambda first: first["at"] <= reach, "event_id"].items():
                held = self.entries.getValue((name,))
                if held is not None:
                    before[row] = held[0]
                    last[name] = max(last[name], held[0])
        for name, at in last[last >= self._oldest(now)].items():
            self.entries.updateValue((name,), (int(at),))
        self._prune(now)
        yield from _found(df.loc[((df["at"] - before) <= self.window).fillna(False).astype(bool), _EVENT])


class RepeatedPayloads(_Pruned):
    """Events whose payload came before, at most a window ago, with first_event_id: of the first of the window."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._init(handle, "payload_hash string", "last_at long, at array<long>, ids array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = _in_order(rows)
        now, reach = int(df["at"].max()), self._reach()
        codes, digests = pd.factorize(df["payload_hash"])
        of, at, ids = [], [], []
        if reach is not None:
            for row, digest in df.drop_duplicates("payload_hash").loc[lambda first: first["at"] <= reach, "payload_hash"].items():
                held = self.entries.getValue((digest,))
                if held is not None:
                    of, at, ids = of + [codes[row]] * len(held[1]), at + list(held[1]), ids + list(held[2])
        # all rows by payload and time, those held before those that come
        row = np.concatenate([np.full(len(of), -1), np.arange(len(df))])
        of, at = np.concatenate([np.array(of, np.int64), codes]), np.concatenate([np.array(at, np.int64), df["at"].to_numpy(np.int64)])
        ids = np.concatenate([np.array(ids, object), df["event_id"].to_numpy(object)])
        order = np.lexsort((row, at, of))
        row, of, at, ids = row[order], of[order], at[order], ids[order]
        # a payload and the number of a time among all times are one number, so that one search finds where each window starts
        times, number = np.unique(at, return_inverse=True)
        place = of * (len(times) + 1) + number
        first = np.searchsorted(place, of * (len(times) + 1) + np.searchsorted(times, at - self.window))
        later = (row >= 0) & (first < np.arange(len(at)))
        ends = np.append(np.flatnonzero(np.diff(of)), len(of) - 1)
        for end in ends[at[ends] >= self._oldest(now)]:
            live = slice(first[end], end + 1)
            self.entries.updateValue((digests[of[end]],), (int(at[end]), at[live].tolist(), ids[live].tolist()))
        self._prune(now)
        yield from _found(df.iloc[row[later]][_EVENT].assign(first_event_id=ids[first[later]]))


class NullRuns(StatefulProcessor):
    """Events and fields at which the rate of nulls in the run of a window rises above the threshold.

    Input: source, event_type, seq, at, window (micros), leaves, nulls (fields that are expected, and null). The state is the run
    that the last event belongs to: its window, and the numbers of events and nulls of each field.
    """

    def __init__(self, settings: Settings):
        self.least, self.threshold = settings.null_min_samples, settings.null_threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "window long, fields array<string>, totals array<long>, nulls array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df, found = _in_order(rows), []
        (expects, kinds), (empties, sets) = (pd.factorize(df[c].map(tuple)) for c in ("leaves", "nulls"))
        held = self.run.get() if self.run.exists() else None
        window = held[0] if held else None
        counts = {f: (t, n) for f, t, n in zip(held[1], held[2], held[3], strict=True)} if held else {}
        for run, some in df.groupby((df["window"] != df["window"].shift()).cumsum(), sort=False):
            if some["window"].iloc[0] != window:
                window, counts = int(some["window"].iloc[0]), {}
            own, empty = expects[some.index], empties[some.index]
            for name in sorted({f for code in np.unique(own) for f in kinds[code]}):
                expected = np.array([name in leaves for leaves in kinds])[own]
                null = np.array([name in nulls for nulls in sets])[empty][expected]
                before = counts.get(name, (0, 0))
                total, nulls = before[0] + np.arange(1, len(null) + 1), before[1] + np.cumsum(null)
                last = np.where(total > 1, (nulls - null) / np.maximum(total - 1, 1), 0.0)
                rate = nulls / total
                for k in np.flatnonzero((total >= self.least) & (last <= self.threshold) & (rate > self.threshold)):
                    row = some[expected].iloc[k]
                    found.append((row["seq"], name, window, int(nulls[k]), int(total[k]), float(rate[k])))
                counts[name] = (int(total[-1]), int(nulls[-1]))
        names = list(counts)
        self.run.update((window, names, [counts[f][0] for f in names], [counts[f][1] for f in names]))
        columns = ["seq", "field_path", "window", "null_count", "total_count", "null_rate"]
        found = pd.DataFrame(found, columns=columns)
        yield from _found(found.assign(source=key[0], event_type=key[1])[["source", "event_type", *columns]])

    def close(self) -> None:
        pass


class WindowCounts(StatefulProcessor):
    """Events at which the count of a window rises above ratio times its baseline.

    Input: source, event_type, seq, at, window (micros). The state has the counts of the windows down to the latest one less the
    retention, the baseline windows and two more. An event of an older window is the first of its window each time.
    """

    def __init__(self, settings: Settings):
        self.size, self.n = to_micros(settings.window_size), settings.anomaly_windows
        self.history, self.least, self.ratio = settings.anomaly_min_history, settings.anomaly_min_count, settings.anomaly_ratio
        self.retention = self.size * (self.n + 2)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "window long", "events long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df, found = _in_order(rows), []
        counts = {k[0]: v[0] for k, v in self.counts.iterator()}
        held, latest = dict(counts), max(counts, default=None)
        for seq, window in zip(df["seq"], df["window"], strict=True):
            latest = window if latest is None else max(latest, window)
            oldest = latest - self.retention
            after = counts.get(window, 0) + 1 if window >= oldest else 1
            if window >= oldest:
                counts[window] = after
            earlier = [counts[w] for k in range(1, self.n + 1) if (w := window - k * self.size) in counts and w >= oldest]
            if len(earlier) >= self.history and after >= self.least:
                baseline = sum(earlier) / len(earlier)
                if (after - 1) / baseline <= self.ratio < after / baseline:
                    found.append((seq, window, after, baseline, after / baseline, len(earlier)))
        for window in set(held) | set(counts):
            if window < latest - self.retention:
                if window in held:
                    self.counts.removeKey((window,))
            elif counts[window] != held.get(window):
                self.counts.updateValue((int(window),), (int(counts[window]),))
        columns = ["seq", "window", "events_so_far", "baseline", "ratio", "history"]
        found = pd.DataFrame(found, columns=columns)
        yield from _found(found.assign(source=key[0], event_type=key[1])[["source", "event_type", *columns]])

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """Sources from which no event is as young as allowed, once each until one comes: by timers, so without new input.

    Input: source, event_type, seq, at, allowed (micros). The state is the latest event of the source and whether it was flagged.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, seq long, event_type string, allowed long, flagged boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        row = _in_order(rows).iloc[-1]
        held = self.last.get() if self.last.exists() else None
        if held is None or (held[0], held[1]) < (row["at"], row["seq"]):
            self.last.update((int(row["at"]), int(row["seq"]), row["event_type"], int(row["allowed"]), False))
            for timer in [*self.handle.listTimers()]:
                self.handle.deleteTimer(timer)
            now = timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(max(int(row["at"] + row["allowed"]) // 1000 + 1, now + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, seq, kind, allowed, flagged = self.last.get()
        if not flagged:
            self.last.update((at, seq, kind, allowed, True))
            yield from _found(pd.DataFrame({"source": [key[0]], "event_type": [kind], "last_seen": [at], "allowed": [allowed]}))

    def close(self) -> None:
        pass


def _bucketed(events: DataFrame, column: str) -> DataFrame:
    bucket = F.pmod(F.xxhash64(column), F.lit(BUCKETS)).alias("bucket")
    return events.where(F.col(column).isNotNull()).select(bucket, micros(F.col("received_at")).alias("at"), *_EVENT)


def _time(of: Column, like: DataFrame) -> Column:
    """Micros as a time of the type of the events' own."""
    return F.timestamp_add("MICROSECOND", of, F.lit("1970-01-01 00:00:00").cast(like.schema["event_timestamp"].dataType))


def repeated_ids(events: DataFrame, settings: Settings) -> DataFrame:
    """Enriched events whose id came at most the duplicate window before."""
    rows = _bucketed(events, "event_id").groupBy("bucket")
    return rows.transformWithStateInPandas(RepeatedIds(settings.duplicate_window), _EVENT_KIND, "Append", "none")


def repeated_payloads(events: DataFrame, settings: Settings) -> DataFrame:
    """Enriched events whose payload came at most the duplicate window before, and first_event_id."""
    rows = _bucketed(events, "payload_hash").groupBy("bucket")
    return rows.transformWithStateInPandas(RepeatedPayloads(settings.duplicate_window), f"{_EVENT_KIND}, first_event_id string", "Append", "none")


def null_spikes(observed: DataFrame, settings: Settings) -> DataFrame:
    """As spikes.null_spikes(), of a stream of events with schema and baseline."""
    seen, at = F.map_from_entries("schema"), window_start(F.col("event_timestamp"), settings.window_size)
    rows = observed.where("baseline IS NOT NULL").select(
        "source", "event_type", "seq", micros(F.col("received_at")).alias("at"), micros(at).alias("window"), P.leaves(F.col("baseline")).alias("leaves"), seen.alias("seen")
    )
    rows = rows.where(F.size("leaves") > 0).withColumn("nulls", F.filter("leaves", lambda path: P.nullish(F.col("seen"), path))).drop("seen")
    kind = "source string, event_type string, seq long, field_path string, window long, null_count long, total_count long, null_rate double"
    found = rows.groupBy("source", "event_type").transformWithStateInPandas(NullRuns(settings), kind, "Append", "none")
    return found.withColumn("window_start", _time(F.col("window"), observed)).drop("window")


def anomaly_spikes(events: DataFrame, settings: Settings) -> DataFrame:
    """As spikes.anomaly_spikes(), of a stream, with the retention of WindowCounts."""
    at = window_start(F.col("event_timestamp"), settings.window_size)
    rows = events.select("source", "event_type", "seq", micros(F.col("received_at")).alias("at"), micros(at).alias("window"))
    kind = "source string, event_type string, seq long, window long, events_so_far long, baseline double, ratio double, history long"
    found = rows.groupBy("source", "event_type").transformWithStateInPandas(WindowCounts(settings), kind, "Append", "none")
    return found.withColumn("window_start", _time(F.col("window"), events)).drop("window")


def stale_sources(events: DataFrame, settings: Settings) -> DataFrame:
    """Rows of source and alert: a STALE_SOURCE alert once a source has been silent for longer than allowed."""
    allowed = (health.stale_after(F.col("source"), F.col("event_type"), settings) * MICROS).cast("long")
    rows = events.select("source", "event_type", "seq", F.unix_micros(F.col("event_timestamp").cast("timestamp")).alias("at"), allowed.alias("allowed"))
    kind = "source string, event_type string, last_seen long, allowed long"
    found = rows.groupBy("source").transformWithStateInPandas(Silence(), kind, "Append", "processingTime")
    last = iso_instant(F.timestamp_micros("last_seen"))
    evidence = F.struct("source", last.alias("last_seen_at"), (F.col("allowed") / MICROS).alias("stale_after_seconds"), F.lit("STALE").alias("status"))
    message = F.concat(F.lit("Source "), F.col("source"), F.lit(" is stale; last event timestamp "), last)
    return found.select("source", alert("STALE_SOURCE", "WARN", message, evidence).alias("alert"))


def keyed_alerts(events: DataFrame, settings: Settings, baselines: DataFrame) -> DataFrame:
    """(seq, alert columns) of a stream of events that bring seq: repeats, spikes of nulls and of counts, from keyed state.

    baselines: schemas.baselines() of the types, as a table; events of other types have no null spikes.
    """
    rows = enrich(events)
    observed = schemas.with_baseline(schemas.observe(rows), baselines)
    found = [
        repeated_ids(rows, settings).select("seq", duplicates.id_alert().alias("a")),
        repeated_payloads(rows, settings).where("first_event_id <> event_id").select("seq", duplicates.payload_alert(settings).alias("a")),
        null_spikes(observed, settings).select("seq", spikes.null_alert(settings).alias("a")),
        anomaly_spikes(rows, settings).select("seq", spikes.anomaly_alert(settings).alias("a")),
    ]
    return reduce(DataFrame.unionByName, found).select("seq", "a.*")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started meanwhile keep their state in RocksDB, which keyed state needs, in two partitions a core.

    Each partition of each detector is a store that is opened and checkpointed in every batch, so that more of them cost
    time without input. A stream that goes on keeps the number that it began with.
    """
    wanted = {_PROVIDER: _ROCKSDB, _PARTITIONS: str(min(int(spark.conf.get(_PARTITIONS)), 2 * spark.sparkContext.defaultParallelism))}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def start(found: DataFrame, folder: str, every: str | None = None) -> StreamingQuery:
    """Write what keyed_alerts() or stale_sources() find to folder/alerts: all that has come, or on and on with a batch `every` so often.

    A later start with the same folder goes on with the state that this one leaves.
    """
    writer = found.writeStream.option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/alerts").format("parquet")
    with rocksdb(found.sparkSession):
        return writer.trigger(availableNow=True).start() if every is None else writer.trigger(processingTime=every).start()


def streamed_alerts(events: DataFrame, settings: Settings, batches: int = 3) -> DataFrame:
    """keyed_alerts() of events that come in stretches of their arrival, with a restart after each."""
    spark, folder = events.sparkSession, new_folder(events.sparkSession)
    baselines = stored(schemas.baselines(schemas.observe(enrich(events))))
    for part in cuts(events, batches):
        land(events.where(part), f"{folder}/input")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/input")
        start(keyed_alerts(stream, settings, baselines), folder).awaitTermination()
    return spark.read.parquet(f"{folder}/alerts")
