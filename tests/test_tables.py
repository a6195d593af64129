import json
import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.config import DEMO_SETTINGS, Settings
from plumbline.functions.ordered import islands
from plumbline.model import ARRIVAL, EVENT
from plumbline.operators import health, incidents
from plumbline.operators.pipeline import process
from plumbline.plans import reads
from plumbline.plans.ingest import counters, current_incidents, current_metrics, current_versions, health_as_of, ingest, quality_alerts, raw_events, refresh_health
from plumbline.scenarios import scenario
from plumbline.sources.events import read_events, to_messages
from plumbline.sources.store import Store, new_folder
from plumbline.streaming.replay import cuts, stream_processed

NOW = datetime(2024, 5, 1, 12, 0, 0)


def test_islands_do_not_depend_on_chunks(spark):
    rows = [(k % 2, k, (k // 6) % 3) for k in range(60)] + [(7, k, 1) for k in range(5)]
    df = spark.createDataFrame(rows, "key int, at int, value int")
    want = None
    for size in (1, 2, 7, 1000):
        got = sorted((r.key, r["at"], r.island) for r in islands(df, ["key"], ["at"], "value", F.floor(F.col("at") / size)).collect())
        want = want or got
        assert got == want
    runs = {(k, i) for k, _, i in want}
    assert len(runs) == 2 * 10 + 1


@pytest.mark.parametrize(
    ("inputs", "low", "high", "state"),
    [((0.0, 0.1, 0.0, 1, False), 70, 100, "HEALTHY"), ((0.0, 0.0, 0.0, 0, True), 65, 65, "STALE"), ((0.8, 0.6, 0.9, 5, True), 0, 50, "STALE"), ((0.8, 0.6, 0.9, 5, False), 0, 60, "UNHEALTHY")],
)
def test_health_score(spark, inputs, low, high, state):
    df = spark.createDataFrame([inputs], "d double, l double, n double, a long, s boolean")
    points = health.score(*[F.col(c) for c in "dlnas"])
    row = df.select(points.alias("p"), health.status(points, F.col("s")).alias("st")).first()
    assert low <= row.p <= high and row.st == state


def test_freshness(spark):
    rows = [("binance", "market_tick", 300), ("coindesk", "rss_article", 1800), ("sourcehero", "document_ingestion", 86400), ("my-RSS-pipeline", "x", 1800)]
    df = spark.createDataFrame([r[:2] for r in rows], "s string, t string")
    got = [r.a for r in df.select(health.stale_after(F.col("s"), F.col("t"), Settings()).alias("a")).collect()]
    assert got == [float(r[2]) for r in rows]


def test_ingest_refresh_and_reads(spark):
    store = Store(spark, new_folder(spark))
    bad = spark.createDataFrame([("", "s", "t", NOW, "{}")], EVENT).selectExpr("*", "cast(99 as long) seq", "event_timestamp received_at")
    rejected = ingest(store, scenario(spark, "mixed-incident", NOW).unionByName(bad), 0, DEMO_SETTINGS, F.lit(NOW + timedelta(seconds=10)))
    assert rejected.count() == 1
    assert store.read("raw_events").count() == 26 and store.read("rejected_events").count() == 1
    stale = store.read("quality_alerts").where("alert_type = 'STALE_SOURCE'")
    assert [r.source for r in stale.collect()] == ["back-door/t1"]
    state = {r.source: r.status for r in store.read("source_health").collect()}
    assert state["back-door/t1"] == "STALE"
    # as of a read: later all have gone silent, and nothing is written
    later = {r.source: r.status for r in health_as_of(store, DEMO_SETTINGS, F.lit(NOW + timedelta(days=2))).collect()}
    assert later.keys() == state.keys() and set(later.values()) == {"STALE"}
    assert {r.source: r.status for r in health_as_of(store, DEMO_SETTINGS, F.lit(NOW + timedelta(seconds=10)), 0).collect()} == state
    assert store.read("source_health").count() == len(state) and stale.count() == 1
    # still stale: no second alert
    refresh_health(store, 1, DEMO_SETTINGS, F.lit(NOW + timedelta(seconds=20)))
    assert stale.sparkSession.read.parquet(f"{store.folder}/quality_alerts").where("alert_type = 'STALE_SOURCE'").count() == 1
    versions = reads.schema_list(store.read("schema_versions"), "depot.survey").collect()
    assert sorted(v.status for v in versions) == ["ACTIVE", "DRIFTING"]
    store.views()
    assert spark.sql("SELECT count(*) FROM raw_events").first()[0] == 26
    table = store.read("quality_alerts")
    assert reads.by_key(table, "id", -5).count() == 0
    both = reads.alerts_list(table, kind="SCHEMA_DRIFT", source="gate").collect()
    assert both and all(r.alert_type == "SCHEMA_DRIFT" and r.source == "gate" for r in both)
    assert reads.alerts_list(table, status="RESOLVED", kind="SCHEMA_DRIFT").count() == 0
    assert reads.alerts_list(table, status=" ").count() == table.count()
    assert reads.recent_events(store.read("raw_events").withColumnRenamed("id", "seq"), 1, 20).count() == 6
    summary = reads.dashboard_summary(store.read("raw_events"), table, store.read("source_health").where("updated_at = timestamp'2024-05-01 12:00:20'"), F.lit(NOW)).first()
    assert summary.total_events == 26 and summary.active_sources == 4 and summary.unhealthy_sources >= 1


def test_receipts_counters_and_responses(spark):
    from pyspark.sql import Observation

    from plumbline.operators.duplicates import payload_matches
    from plumbline.operators.envelope import enrich
    from plumbline.plans.ingest import counted, raw_events, receipt

    events = scenario(spark, "field-range", NOW)
    first, second = receipt(events).first(), receipt(events).first()
    assert first.accepted == 1 and first.batch_id != second.batch_id
    seen = Observation()
    done = counted(process(events, DEMO_SETTINGS), seen)
    assert reads.response(raw_events(done), "raw_events").first().event_id == "t1:overload"
    assert seen.get == {"events_ingested": 1, "alerts_fired": 1}
    rows = enrich(scenario(spark, "duplicate-events", NOW))
    digest = rows.first().payload_hash
    assert payload_matches(rows, digest, F.lit(NOW - timedelta(seconds=1)), "other").count() == 1
    assert payload_matches(rows, digest, F.lit(NOW), "other").count() == 0
    assert payload_matches(rows, digest, F.lit(NOW - timedelta(seconds=1)), "t1:again").count() == 0


def test_empty_store(spark):
    store = Store(spark, new_folder(spark))
    assert store.read("quality_alerts").count() == 0 and store.read("raw_events", before=3).count() == 0


def alert_rows(spark, seconds, kind="A"):
    rows = [(k, kind, "s", "t", NOW + timedelta(seconds=s)) for k, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "id long, alert_type string, source string, event_type string, created_at timestamp")


def test_incidents_are_anchored(spark):
    seconds = [0, 200, 299, 300, 500, 599, 600, 2000, 2000]
    done = incidents.correlate(alert_rows(spark, seconds), 300)
    starts = {r.id: int((r.incident_start - NOW).total_seconds()) for r in done.collect()}
    assert starts == {0: 0, 1: 0, 2: 0, 3: 300, 4: 300, 5: 300, 6: 600, 7: 2000, 8: 2000}
    table = incidents.incidents(done)
    assert sorted((r.title, r.alerts) for r in table.collect()) == [("A on s", 1), ("A on s", 2), ("A on s", 3), ("A on s", 3)]
    assert [r.created_at for r in reads.incidents_list(table).collect()] == sorted((r.created_at for r in table.collect()), reverse=True)


def test_life_cycle(spark):
    found = alert_rows(spark, [0, 1, 2, 3])
    at = lambda s: NOW + timedelta(seconds=s)
    actions = spark.createDataFrame(
        [(0, "acknowledge", at(5), None, None), (1, "resolve", at(5), None, None), (2, "acknowledge", at(5), "ann", None), (2, "resolve", at(6), None, "cause"), (9, "resolve", at(1), None, None)],
        "id long, action string, at timestamp, by string, root_cause string",
    )
    rows = {r.id: r for r in incidents.apply_actions(found, actions).collect()}
    assert [rows[k].status for k in range(4)] == ["ACKNOWLEDGED", "RESOLVED", "RESOLVED", "OPEN"]
    assert rows[0].acknowledged_by == "anonymous" and rows[1].root_cause == "" and rows[2].acknowledged_by == "ann" and rows[2].root_cause == "cause"
    assert rows[1].acknowledged_by is None and rows[3].resolved_at is None
    row = incidents.stats(incidents.apply_actions(found, actions)).first()
    assert tuple(row) == (4, 1, 1, 2)
    table = incidents.incidents(incidents.correlate(found, 1)).withColumn("id", F.monotonically_increasing_id()).withColumn("resolved_at", F.lit(None).cast("timestamp"))
    some = table.first().id
    done = incidents.resolve_incident(table, some, F.lit(NOW)).where("status = 'RESOLVED'").collect()
    assert [r.id for r in done] == [some] and done[0].resolved_at == NOW


def test_stream_equals_batch(spark):
    df = scenario(spark, "null-spike", NOW).unionByName(
        scenario(spark, "duplicate-events", NOW, "t2").selectExpr("* except (seq, received_at)", "seq + 100 seq", "received_at + interval 7 seconds received_at")
    )
    store = stream_processed(df, DEMO_SETTINGS, batches=2)
    got = alert_keys(store.read("quality_alerts").where("alert_type <> 'STALE_SOURCE'"))
    assert got == alert_keys(quality_alerts(process(df, DEMO_SETTINGS)))
    states = lambda rows: sorted((r.id, r.quality_status) for r in rows.select("id", "quality_status").collect())
    assert states(store.read("raw_events")) == states(raw_events(process(df, DEMO_SETTINGS)))


def alert_keys(rows):
    return sorted((r.id, r.alert_type, r.message, r.evidence_json) for r in rows.collect())


def test_batches_equal_one_with_late_events_and_spikes(spark):
    """Nulls and counts that go on across batches, late events of older windows, repeats of ids and payloads."""
    rng = random.Random(8)
    rows, t = [], 0.0
    for k in range(240):
        t += rng.choice([0.2, 1, 4, 20])
        late = rng.choice([0, 0, 0, 30, 90])
        payload = {"a": None if rng.random() < 0.5 else k % 9, "b": 1} | ({"c": {"d": {"e": {"f": {"g": 1}}}}} if k % 40 == 39 else {})
        at = NOW + timedelta(seconds=t)
        rows.append((f"e{k - (k % 17 == 0)}", rng.choice("st"), "tick", at - timedelta(seconds=late), json.dumps(payload), k, at))
    df = spark.createDataFrame(rows, f"{EVENT}, {ARRIVAL}")
    settings = replace(Settings(), null_threshold=0.5, anomaly_ratio=1.3, anomaly_min_count=3)
    whole = quality_alerts(process(df, settings))
    kinds = {r.alert_type for r in whole.collect()}
    assert {"DUPLICATE_EVENT", "SCHEMA_DRIFT", "NULL_SPIKE", "ANOMALY_SPIKE"} <= kinds
    store, one = Store(spark, new_folder(spark)), Store(spark, new_folder(spark))
    for part, condition in enumerate(cuts(df, 2)):
        ingest(store, df.where(condition), part, settings, F.lit(NOW))
    ingest(store, df.where(cuts(df, 2)[1]), 1, settings, F.lit(NOW))  # a part that comes again
    ingest(one, df, 0, settings, F.lit(NOW))
    assert alert_keys(store.read("quality_alerts").where("alert_type <> 'STALE_SOURCE'")) == alert_keys(whole)
    same = lambda f: sorted(map(tuple, f(store).collect()), key=str) == sorted(map(tuple, f(one).collect()), key=str)
    assert same(current_versions) and same(lambda s: current_metrics(s, settings)) and same(counters)
    assert [r.n for r in current_versions(store).where("status = 'ACTIVE'").groupBy("event_type").agg(F.count("*").alias("n")).collect()] == [1]
    assert "c.d.e.f.g" in current_versions(store).where("schema_json LIKE '%c.d%'").first().schema_json


def test_drift_and_repeats_across_two_batches(spark):
    store = Store(spark, new_folder(spark))
    for part, payload in enumerate(('{"a":1}', '{"a":"x"}')):
        at = NOW + timedelta(seconds=part)
        df = spark.createDataFrame([("e1", "s", "t", at, payload, part, at)], f"{EVENT}, {ARRIVAL}")
        ingest(store, df, part, Settings(), F.lit(NOW))
    found = sorted(r.message for r in store.read("quality_alerts").collect())
    assert found == ["Repeated event_id e1", "Schema drift in t (missing=0, added=0, type_changed=1)"]
    assert sorted(r.status for r in current_versions(store).collect()) == ["ACTIVE", "DRIFTING"]
    counts = current_metrics(store, Settings()).where("metric_name = 'EVENT_COUNT'").collect()
    assert [r.metric_value for r in counts] == [2.0]
    assert tuple(counters(store).first()) == (2, 2)


def test_json_source_and_messages(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"event_id":"e1","source":"s","event_type":"t","event_timestamp":"2024-05-01T12:00:00Z","payload":{"b":1,"a":null}}\n')
    df = read_events(spark, str(tmp_path))
    row = df.first()
    assert row.payload == '{"b":1,"a":null}' and row.event_timestamp == NOW
    message = to_messages(df).first()
    assert message.key == "s|t" and '"payload":{"a":null,"b":1}' in message.value


def test_incidents_go_on_over_batches(spark):
    """A part again, an incident that was resolved, and one that is over."""
    settings = replace(Settings(), incident_window=100.0)
    rows = [(f"e{k // 2}", "s", "t", NOW + timedelta(seconds=s), "{}", k, NOW + timedelta(seconds=s)) for k, s in enumerate((0, 1, 90, 91, 99, 105, 160, 161, 230, 231, 600, 601))]
    df = spark.createDataFrame(rows, f"{EVENT}, {ARRIVAL}")
    store, one = Store(spark, new_folder(spark)), Store(spark, new_folder(spark))
    ingest(one, df, 0, settings, F.lit(NOW))
    for part, (low, high) in enumerate([(0, 3), (3, 7), (7, 11), (11, 12)]):
        for _ in range(2 if part == 1 else 1):
            ingest(store, df.where(f"seq >= {low} and seq < {high}"), part, settings, F.lit(NOW))
    shown = lambda s: sorted((r.id, r.title, r.created_at, r.alerts) for r in current_incidents(s).collect())
    assert shown(store) == shown(one) and len(shown(one)) >= 3
    of = lambda s: sorted((r.id, r.incident_id) for r in s.read("quality_alerts").where("alert_type <> 'STALE_SOURCE'").collect())
    assert of(store) == of(one) and all(i for _, i in of(one))


def test_a_source_is_read_once_in_an_ingest(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(name):
        read.add(1)
        return name

    rows = [(f"e{k}", "s", "t", NOW + timedelta(seconds=k), '{"a":1}', k, NOW + timedelta(seconds=k)) for k in range(40)]
    events = spark.createDataFrame(rows, f"{EVENT}, {ARRIVAL}").withColumn("event_id", F.udf(seen, "string")("event_id"))
    store = Store(spark, new_folder(spark))
    ingest(store, events, 0, Settings(), F.lit(NOW))
    assert store.read("raw_events").count() == 40 and read.value == 40


def test_actions_are_grouped_once(spark):
    table = spark.createDataFrame([(1, "OPEN"), (2, "OPEN")], "id long, status string")
    actions = spark.createDataFrame([(1, "resolve", datetime(2024, 1, 1), None, "x")], "id long, action string, at timestamp, by string, root_cause string")
    done = incidents.apply_actions(table, actions)
    assert {(r["id"], r["status"], r["root_cause"]) for r in done.collect()} == {(1, "RESOLVED", "x"), (2, "OPEN", None)}
    assert done._jdf.queryExecution().analyzed().toString().count("Aggregate") == 1


def test_alerts_are_not_joined_to_themselves(spark):
    at = datetime(2024, 1, 1)
    rows = [(k, "LATE_EVENT", "s", "t", at + timedelta(seconds=200 * k), f"m{k}", None) for k in range(4)]
    table = spark.createDataFrame(rows, "id long, alert_type string, source string, event_type string, created_at timestamp, message string, incident_id long")
    before = spark.createDataFrame([(99, "s", "t", at - timedelta(seconds=100))], "id long, source string, event_type string, created_at timestamp")
    named, new = incidents.attach(table, before, 300)
    assert {(r["id"], r["message"], r["incident_id"]) for r in named.collect()} == {(0, "m0", 99), (1, "m1", 1), (2, "m2", 1), (3, "m3", 3)}
    assert {r["id"] for r in new.collect()} == {1, 3}
    # no shuffle by the id of an alert
    assert "hashpartitioning(id#" not in named._jdf.queryExecution().executedPlan().toString()
    assert set(named.columns) == set(table.columns)
