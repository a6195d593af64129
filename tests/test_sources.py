import json
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.config import DEMO_SETTINGS
from plumbline.plans.ingest import counters, ingest
from plumbline.scenarios import scenario
from plumbline.sources import store as stores
from plumbline.sources.arrival import numbered
from plumbline.sources.events import from_messages, read_events, stream_events, to_messages, write_json
from plumbline.sources.store import Store, new_folder
from plumbline.streaming.live import LiveCounters
from plumbline.streaming.replay import run, start

NOW = datetime(2024, 5, 1, 12, 0, 0)


def lines(path, rows, when):
    """JSON lines in a file that was changed at a time (seconds)."""
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(path, (when, when))


def event(name, payload=None, **more):
    return {"event_id": name, "source": "s", "event_type": "t", "event_timestamp": "2024-05-01T12:00:00Z", "payload": payload or {"a": 1}} | more


def numbers(df):
    return {r.event_id: r.seq for r in df.select("event_id", "seq").collect()}


def test_numbers_of_lines_do_not_depend_on_splits(spark, tmp_path):
    lines(tmp_path / "b.json", [event(f"b{k:03d}") for k in range(200)], 1000)
    lines(tmp_path / "a.json", [event(f"a{k:03d}") for k in range(100)], 2000)
    want = {f"b{k:03d}": 7 + k for k in range(200)} | {f"a{k:03d}": 207 + k for k in range(100)}
    for size in ("128m", "1k", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found, used = numbered(read_events(spark, str(tmp_path)), 7)
            assert numbers(found) == want and used == 300
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.received_at for r in found.select("received_at").distinct().orderBy("received_at").collect()] == [datetime.fromtimestamp(1000), datetime.fromtimestamp(2000)]


def test_numbers_of_messages_and_of_plain_frames(spark):
    rows = [("raw", p, o, f"{p}{o}") for p in (0, 1) for o in (5, 6, 9)]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, event_id string")
    from plumbline.sources.arrival import message_origin

    found, used = numbered(df.select("event_id", message_origin().alias("origin")).repartition(3))
    assert numbers(found) == {"05": 0, "06": 1, "09": 4, "15": 5, "16": 6, "19": 9} and used == 10
    plain, used = numbered(df.select("event_id"), 3)
    assert sorted(numbers(plain).values()) == list(range(3, 9)) and used == 6
    assert numbered(df.select("event_id").limit(0))[1] == 0
    own, used = numbered(df.select("event_id", F.lit(4).alias("seq")))
    assert used == 0 and {r.seq for r in own.collect()} == {4}


def test_json_batches_are_taken_in_with_the_same_ids_again(spark, tmp_path):
    (tmp_path / "1").mkdir(), (tmp_path / "2").mkdir()
    lines(tmp_path / "1" / "x.json", [event("e1"), event("e2", {"a": "text"}), event("", {"a": 1})], NOW.timestamp())
    (tmp_path / "1" / "broken.json").write_text("no json\n")
    lines(tmp_path / "2" / "y.json", [event("e1", received_at="2024-05-01T12:00:30.123456Z"), event("e3", {"a": 5})], NOW.timestamp() + 60)
    store = Store(spark, new_folder(spark))
    rejected = ingest(store, read_events(spark, str(tmp_path / "1")), 0, DEMO_SETTINGS, F.lit(NOW))
    assert rejected.count() == 2
    for _ in range(2):
        ingest(store, read_events(spark, str(tmp_path / "2")), 1, DEMO_SETTINGS, F.lit(NOW))
        events = {(r.id, r.event_id, r.received_at) for r in store.read("raw_events").collect()}
        assert len(events) == 4 and {(e, at) for n, e, at in events if n > 3} == {("e1", datetime(2024, 5, 1, 12, 0, 30, 123456)), ("e3", NOW + timedelta(seconds=60))}
        found = sorted((r.alert_type, r.message) for r in store.read("quality_alerts").where("alert_type <> 'STALE_SOURCE'").collect())
        assert found == [("DUPLICATE_EVENT", "Repeated event_id e1"), ("SCHEMA_DRIFT", "Schema drift in t (missing=0, added=0, type_changed=1)")]
    assert len({n for n, _, _ in events}) == 4 and tuple(counters(store).first()) == (4, 2)


@pytest.mark.parametrize("form", ["lines", "messages"])
def test_streams_go_on_with_their_numbers(spark, tmp_path, form):
    events = scenario(spark, "mixed-incident", NOW).unionByName(scenario(spark, "null-spike", NOW + timedelta(seconds=60), "t2").withColumn("seq", F.col("seq") + 1000))
    halves = [events.where("seq < 1000"), events.where("seq >= 1000")]
    ids = []
    for attempt in range(2):
        folder = new_folder(spark)
        for half in halves:
            if form == "lines":
                write_json(half, f"{folder}/in")
                stream = stream_events(spark, f"{folder}/in")
            else:
                schema = "key string, value string, topic string, partition int, offset long, timestamp timestamp"
                messages = half.selectExpr("*", "'raw' topic", "cast(1 as int) partition", "seq offset", "received_at timestamp")
                to_messages(messages, "topic", "partition", "offset", "timestamp").write.mode("append").parquet(f"{folder}/in")
                stream = from_messages(spark.readStream.schema(schema).parquet(f"{folder}/in"))
            store = run(stream, folder, DEMO_SETTINGS, F.lit(NOW))
        ids.append(sorted((r.id, r.event_id) for r in store.read("raw_events").collect()))
        assert len({n for n, _ in ids[-1]}) == events.count()
    assert ids[0] == ids[1]
    one = Store(spark, new_folder(spark))
    ingest(one, events, 0, DEMO_SETTINGS, F.lit(NOW))
    kinds = lambda s: sorted((r.alert_type, r.message) for r in s.read("quality_alerts").where("alert_type <> 'STALE_SOURCE'").collect())
    assert kinds(store) == kinds(one)


def files_of(store, table):
    held = store.folder.removeprefix("file://") + "/" + table
    return [f for _, _, names in os.walk(held) for f in names if f.endswith(".parquet")]


def test_many_small_parts_stay_few_segments(spark, monkeypatch):
    monkeypatch.setattr(Store, "FAN", 4)
    store = Store(spark, new_folder(spark), {"raw_events": "id long, received_at timestamp, event_id string, payload_hash string, source string"})
    rows = lambda part: spark.range(part * 10, part * 10 + 3).selectExpr("id", "timestamp_seconds(id) received_at", "cast(id as string) event_id", "'' payload_hash", "'s' source").coalesce(1)
    want, most = {}, 0
    for part in range(60):
        store.write("raw_events", rows(part), part)
        want[part] = {part * 10 + k for k in range(3)}
        if part % 7 == 6:  # the last part again, and one that has been merged
            store.write("raw_events", rows(part).limit(2), part)
            store.write("raw_events", rows(part // 2).limit(1), part // 2)
            want[part], want[part // 2] = {part * 10, part * 10 + 1}, {part // 2 * 10}
        if part % 5 == 0:
            store.write("raw_events", rows(part).withColumn("id", -F.col("id") - 1), -part - 1)
            want[-part - 1] = {-part * 10 - k - 1 for k in range(3)}
        most = max(most, len(store.manifest("raw_events").segments))
    ids = lambda **k: {r.id for r in store.read("raw_events", **k).collect()}
    of = lambda keep: set().union(*[v for p, v in want.items() if keep(p)])
    assert ids() == of(lambda p: True) and store.read("raw_events").count() == sum(map(len, want.values()))
    assert ids(before=23) == of(lambda p: p < 23) and ids(after=40) == of(lambda p: p > 40) and ids(before=0, after=-30) == of(lambda p: -30 < p < 0)
    assert ids(parts=[3, 27, 59, -6]) == of(lambda p: p in (3, 27, 59, -6)) and ids(parts=[]) == set() and ids(before=-100) == set()
    assert most <= 24 and len(files_of(store, "raw_events")) <= 40
    assert len(os.listdir(store.folder.removeprefix("file://") + "/raw_events/_manifest")) <= 6


def test_merged_tables_skip_row_groups(spark, monkeypatch):
    monkeypatch.setattr(Store, "FAN", 2)
    monkeypatch.setattr(Store, "FILE_BYTES", 20_000)
    store = Store(spark, new_folder(spark), {"raw_events": "id long, received_at timestamp, event_id string, payload_hash string, source string"})
    for part in range(3):
        rows = spark.range(part, 60_000, 3).selectExpr("id", "timestamp_seconds(id) received_at", "sha1(cast(id as string)) event_id", "md5(cast(id as string)) payload_hash", "'s' source")
        store.write("raw_events", rows.repartition(4, "event_id"), part)
    merged = [s for s in store.manifest("raw_events").segments if s.level]
    assert len(merged) == 1 and len(files_of(store, "raw_events")) > 20
    table = store._rows("raw_events", merged)

    def scanned(condition):
        df = table.where(condition)
        found = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().apply(0)
        return len(found), leaf.metrics().apply("numOutputRows").value()

    total = table.count()
    digest = table.where("id = 30000").first()
    for condition in ("id = 30000", f"event_id = '{digest.event_id}'", f"payload_hash = '{digest.payload_hash}'", "received_at between timestamp_seconds(30000) and timestamp_seconds(30002)"):
        rows, read = scanned(condition)
        assert 1 <= rows <= 3 and read < total / 10, condition


def test_batches_leave_no_intermediate_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "shared_folder", lambda _: f"file://{tmp_path}")
    store = Store(spark, f"file://{tmp_path}/store")
    for part in range(2):
        ingest(store, scenario(spark, "mixed-incident", NOW).withColumn("seq", F.col("seq") + 100 * part), part, DEMO_SETTINGS, F.lit(NOW))
    assert os.listdir(tmp_path) == ["store"]
    assert store.read("raw_events").count() == 52


def test_one_writer(spark):
    store = Store(spark, new_folder(spark), {"a": "x long"})
    store.write("a", spark.range(2).toDF("x"), 0)
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit("a", store.manifest("a"))
    assert store.exists("a") and not store.exists("b") and store.read("a").count() == 2


def test_the_last_of_repeated_keys_counts(spark, tmp_path):
    body = '{"event_id":"e1","source":"s","event_type":"t","event_timestamp":"2024-05-01T12:00:00Z","payload":{"a":1,"b":{"c":1,"c":"x"},"a":null}}'
    (tmp_path / "x.json").write_text(body + "\n")
    store = Store(spark, new_folder(spark))
    ingest(store, read_events(spark, str(tmp_path)), 0, DEMO_SETTINGS, F.lit(NOW))
    assert json.loads(store.read("schema_versions").first().schema_json) == {"a": "NULL", "b": "OBJECT", "b.c": "STRING"}


def test_counters_of_a_running_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder = new_folder(spark)
    write = lambda k: lines(tmp_path / "in" / f"{k}.json", [event(f"e{k}", {"a": k}), event("same", {"a": -k})], 1000 + k)
    write(0)
    # a batch before the listener is there
    store = run(stream_events(spark, str(tmp_path / "in")), folder, DEMO_SETTINGS)
    live = LiveCounters(store)
    assert live.totals()["events_ingested"] == 2
    _, query = start(stream_events(spark, str(tmp_path / "in")), folder, DEMO_SETTINGS, every="1 second")
    live.follow(query)
    try:
        for k in (1, 2):
            write(k)
            end = time.time() + 90
            while live.totals()["batches"] < k + 1 and time.time() < end:
                assert query.exception() is None
                time.sleep(0.2)
            want = counters(store).first()
            assert query.isActive and live.totals()["events_ingested"] == want["events_ingested"] == 2 * k + 2
            assert live.totals()["alerts_fired"] == want["alerts_fired"] >= k
        assert live.totals()["batch_milliseconds"] > 0
    finally:
        query.stop()
        live.close()
