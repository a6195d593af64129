import json
import random
import time
from dataclasses import replace
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.config import Settings
from plumbline.model import ARRIVAL, EVENT
from plumbline.operators import alerts, schemas
from plumbline.operators.envelope import enrich
from plumbline.operators.pipeline import process
from plumbline.sources.store import new_folder
from plumbline.streaming import state
from plumbline.streaming.windows import final_sums, streamed_windows

NOW = datetime(2024, 5, 1, 12, 0, 0)
KINDS = ("DUPLICATE_EVENT", "NULL_SPIKE", "ANOMALY_SPIKE")


def frame(spark, rows):
    """rows: (event_id, source, event_type, event seconds, payload, seq, received seconds)."""
    at = lambda s: NOW + timedelta(seconds=s)
    return spark.createDataFrame([(e, s, t, at(x), json.dumps(p), n, at(y)) for e, s, t, x, p, n, y in rows], f"{EVENT}, {ARRIVAL}")


def test_state_equals_tables_over_batches_with_restarts(spark):
    rng = random.Random(4)
    rows, t = [], 0.0
    for k in range(300):
        t += rng.choice([0, 0.2, 1, 4, 20])
        late = rng.choice([0, 0, 0, 30, 90])
        payload = {"a": None if rng.random() < 0.5 else k % 9, "b": 1} | ({"c": 1} if k % 50 == 49 else {})
        rows.append((f"e{k - (k % 13 == 0)}", rng.choice("st"), rng.choice(["tick", "tock"]), t - late, payload, k, t))
    settings = replace(Settings(), null_threshold=0.5, anomaly_ratio=1.3, anomaly_min_count=3)
    df = frame(spark, rows)
    want = alerts.exploded(process(df, settings)).where(F.col("alert_type").isin(*KINDS))
    key = lambda df: sorted((r.seq, r.alert_type, r.message, r.evidence_json) for r in df.select("seq", "alert_type", "message", "evidence_json").collect())
    want = key(want)
    assert {k for _, k, _, _ in want} == set(KINDS)
    assert key(state.streamed_alerts(df, settings, 3)) == want


class Held(dict):
    """State of a processor, as a test sees it."""

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


class One:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def joined(frames):
    frames = list(frames)
    return pd.concat(frames) if frames else pd.DataFrame(columns=["seq", "window", "events_so_far", "baseline", "first_event_id"])


def test_counts_of_expired_windows():
    """An event of a window beyond the retention counts as the first of it, and is not held."""
    counts = state.WindowCounts(replace(Settings(), anomaly_min_count=1, anomaly_ratio=0.4, anomaly_min_history=1))
    counts.counts = Held()
    minute = 60 * 1_000_000
    rows = [(k, 10 * minute) for k in range(3)] + [(10, 7 * minute), (11, 5 * minute), (12, 6 * minute), (13, 11 * minute), (14, 6 * minute)]
    df = pd.DataFrame({"seq": [s for s, _ in rows], "at": range(len(rows)), "window": [w for _, w in rows]})
    found = joined(counts.handleInputRows(("s", "t"), iter([df]), None))
    # 5 is older than 10 - 4, so it is not held, and 6 has no history; 11 has that of 10; then 6 is beyond the retention
    assert found[["seq", "window", "events_so_far", "baseline"]].values.tolist() == []
    assert counts.counts == {(7 * minute,): (1,), (10 * minute,): (3,), (11 * minute,): (1,)}
    burst = pd.DataFrame({"seq": range(20, 24), "at": range(20, 24), "window": [11 * minute] * 4})
    found = joined(counts.handleInputRows(("s", "t"), iter([burst]), None))
    assert found[["seq", "events_so_far", "baseline", "history"]].values.tolist() == [[20, 2, 3.0, 1]]
    # an expired event may cross by itself: it counts as 1 against the windows before it that are held
    late = pd.DataFrame({"seq": [30, 31, 32], "at": [30, 31, 32], "window": [9 * minute] * 3})
    counts.ratio = 0.9
    found = joined(counts.handleInputRows(("s", "t"), iter([late]), None))
    assert found[["seq", "events_so_far", "baseline", "ratio"]].values.tolist() == [[30, 1, 1.0, 1.0]]


@pytest.mark.parametrize("kind", [state.RepeatedIds, state.RepeatedPayloads])
def test_state_of_repeats_is_bounded(kind):
    processor = kind(100.0)
    processor.entries, processor.clock = Held(), One()
    sizes, second = [], 1_000_000
    for batch in range(60):
        rows = [(batch * 50 + k, (batch * 50 + k) * second) for k in range(50)]
        df = pd.DataFrame({"seq": [s for s, _ in rows], "at": [a for _, a in rows], "source": "s", "event_type": "t", "event_id": [f"e{s}" for s, _ in rows], "payload_hash": [f"p{s % 75 if s % 2 else s}" for s, _ in rows]})
        found = joined(processor.handleInputRows((0,), iter([df]), None))
        if kind is state.RepeatedPayloads and batch > 3:
            assert len(found) == 0 or set(found["seq"] - found["first_event_id"].str[1:].astype(int)) <= {75}
        sizes.append(len(processor.entries))
    assert max(sizes[20:]) <= 100 + 100 + 60 + 50 and max(sizes[40:]) <= max(sizes[20:40])


def test_silent_source_is_flagged_once_without_new_input(spark):
    folder = new_folder(spark)
    settings = replace(Settings(), stale_after=4.0)
    schema = f"{EVENT}, {ARRIVAL}"
    now = datetime.now()
    rows = [("e1", "quiet", "tick", now, "{}", 1, now), ("e2", "rss-feed", "tick", now, "{}", 2, now), ("e0", "quiet", "tick", now - timedelta(hours=1), "{}", 3, now)]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/input")
    query = state.start(state.stale_sources(spark.readStream.schema(schema).parquet(f"{folder}/input"), settings), folder, every="1 second")
    try:
        found, end = [], time.time() + 90
        while not found and time.time() < end:
            time.sleep(2)
            if query.lastProgress and query.lastProgress["batchId"] > 0:
                found = spark.read.schema("source string, alert struct<alert_type:string,event_type:string,message:string>").parquet(f"{folder}/alerts").collect()
        time.sleep(6)
        found = spark.read.parquet(f"{folder}/alerts").collect()
    finally:
        query.stop()
    assert [(r.source, r.alert.alert_type, r.alert.event_type) for r in found] == [("quiet", "STALE_SOURCE", "tick")]
    assert found[0].alert.message.startswith("Source quiet is stale; last event timestamp ")


def test_windows_are_final_once_and_late_events_are_flagged(spark):
    rows = [(f"e{k}", "s", "t", k * 10, {"a": None if k % 3 == 0 else 1}, k, k * 10) for k in range(60)]
    rows += [("late", "s", "t", 5, {"a": None}, 100, 601), ("within", "s", "t", 545, {"a": 1}, 101, 602), ("last", "s", "t", 610, {"a": 1}, 102, 610)]
    df = frame(spark, rows)
    settings = replace(Settings(), window_size=60.0)
    done = streamed_windows(df, settings, "2 minutes", batches=3).collect()
    count = {(int((r.window_start - NOW).total_seconds()), r.status): r.total for r in done if r.field_path is None}
    final = [k for k, s in count if s == "FINAL"]
    assert final and len(final) == len(set(final)) and all(count[k, "FINAL"] == 6 for k in final)
    assert count[0, "LATE"] == 1 and [k for k, s in count if s == "LATE"] == [0]
    assert sum(count.values()) == len(rows) and {k for k, s in count if s == "OPEN"}.isdisjoint(final)
    nulls = [r for r in done if r.field_path == "a"]
    assert sum(r.nulls for r in nulls) == 21 and [r.nulls for r in nulls if r.status == "LATE"] == [1.0]


class Counted(Held):
    """Held that counts what it is asked for one by one."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return super().getValue(key)

    def updateValue(self, key, value):
        self.calls += 1
        super().updateValue(key, value)


@pytest.mark.parametrize("kind", [state.RepeatedIds, state.RepeatedPayloads])
def test_calls_to_the_state_of_repeats_do_not_grow_with_a_batch(kind):
    second, rng = 1_000_000, random.Random(8)
    rows = [(s, s * second, f"e{rng.randrange(4000)}", f"p{rng.randrange(4000)}") for s in range(8000)]
    df = pd.DataFrame(rows, columns=["seq", "at", "event_id", "payload_hash"]).assign(source="s", event_type="t")
    column, window = ("event_id", 100.0) if kind is state.RepeatedIds else ("payload_hash", 100.0)
    last, want = {}, {}
    for s, at, name, digest in rows:
        held = last.setdefault(name if kind is state.RepeatedIds else digest, [])
        near = [n for t, n in held if at - t <= window * second]
        if near:
            want[s] = near[0]
        held.append((at, name))
    processor = kind(window)
    processor.entries, processor.clock, found = Counted(), One(), []
    for part in (df[:3000], df[3000:3001], df[3001:3050], df[3050:]):
        found.extend(processor.handleInputRows((0,), iter([part.reset_index(drop=True)]), None))
    found = pd.concat(found)
    assert set(found["seq"]) == set(want) and len(want) > 100
    if column == "payload_hash":
        assert dict(zip(found["seq"], found["first_event_id"], strict=True)) == want
    # what a window and its grace hold, at the end and at the start of each of the four batches
    assert processor.entries.calls <= 4 * 2 * (window + state.GRACE)


def test_streamed_windows_walk_through_shapes_and_not_events(spark, tmp_path):
    events = spark.createDataFrame([], f"{EVENT}, {ARRIVAL}")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    baselines = schemas.baselines(schemas.describe(enrich(events)).kinds)
    plan = final_sums(stream, Settings(), baselines, "1 minute")._jdf.queryExecution().analyzed().toString().splitlines()
    walk = next(k for k, line in enumerate(plan) if "regexp_extract_all" in line)
    # the events are below: they are counted by shape before a shape is walked through
    assert any("Aggregate" in line and "__shape" in line for line in plan[walk + 1 :])
