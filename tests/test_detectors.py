import json
import random
import re
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.config import DEMO_SETTINGS, Bounds, Settings, iso_duration, parse_formats
from plumbline.functions import payload as P
from plumbline.model import ARRIVAL, EVENT
from plumbline.operators import alerts, envelope, fields, pipeline, schemas, spikes
from plumbline.operators.pipeline import process
from plumbline.scenarios import SCENARIOS, scenario

NOW = datetime(2024, 5, 1, 12, 0, 0)


def events(spark, *rows):
    """rows: (event_id, event time, payload JSON, arrival) of one source and type."""
    full = [(i, "s1", "tick", at, p, k, got) for k, (i, at, p, got) in enumerate(rows)]
    return spark.createDataFrame(full, f"{EVENT}, {ARRIVAL}")


def alone(spark, settings, *rows):
    """Rows of what the detectors that need one event only find: (payload, seconds late) each."""
    df = envelope.enrich(events(spark, *[("e", NOW - timedelta(seconds=late), payload, NOW) for payload, late in rows]))
    df = alerts.add(df, fields.late_event(settings), *fields.field_ranges(settings), *fields.field_formats(settings))
    return df.withColumn("quality_status", alerts.quality_status(F.col("alerts"))).orderBy("seq").collect()


def test_round_trip(spark):
    row = process(events(spark, ("e", NOW, '{"bid": 1.0}', NOW)), Settings()).first()
    assert row.quality_status == "OK" and row.alerts == [] and len(row.payload_hash) == 64


def test_repeated_id_and_payload(spark):
    df = events(
        spark,
        ("a", NOW, '{"x":1}', NOW),
        ("a", NOW, '{"x":1}', NOW + timedelta(seconds=300)),
        ("b", NOW, '{"x":1}', NOW + timedelta(seconds=301)),
        ("a", NOW, '{"x":2}', NOW + timedelta(seconds=601)),
        ("c", NOW, '{"x":3}', NOW + timedelta(seconds=602)),
        ("d", NOW, '{"x":3}', NOW + timedelta(seconds=602)),
    )
    done = process(df, replace(Settings(), late_threshold=1e6, anomaly_ratio=1e9))
    rows = {r.seq: r for r in done.collect()}
    kinds = {s: [a.message for a in r.alerts if a.alert_type == "DUPLICATE_EVENT"] for s, r in rows.items()}
    assert kinds[0] == [] and kinds[1] == ["Repeated event_id a"]
    assert kinds[2] == ["Repeated payload hash within PT5M; first event_id=a"]
    assert kinds[3] == []  # 301 seconds after the one before
    assert kinds[4] == [] and len(kinds[5]) == 1
    assert rows[1].quality_status == "DUPLICATE"


def test_late(spark):
    cases = {30: None, 300: None, 600: "INFO", 3000: "INFO", 7200: "WARN"}
    for row, (late, severity) in zip(alone(spark, Settings(), *[('{"x":1}', s) for s in cases]), cases.items(), strict=True):
        assert [a.severity for a in row.alerts] == ([severity] if severity else [])
        if severity:
            assert f'"lateness_seconds":{late}' in row.alerts[0].evidence_json and '"threshold":"PT5M"' in row.alerts[0].evidence_json
            assert row.quality_status == "LATE"


def test_range(spark):
    cases = {"99.5": 0, "-1.0": 1, "2000000": 1, "0.0": 0, "100.0": 0, "null": 0, '"500"': 0, "[500]": 0}
    rows = alone(spark, Settings(ranges={"price": Bounds(0, 100)}), *[(f'{{"price": {p}}}', 0) for p in cases])
    assert [[a.alert_type for a in r.alerts] for r in rows] == [["FIELD_OUT_OF_RANGE"] * n for n in cases.values()]


def test_range_open_bounds_and_missing(spark):
    settings = Settings(ranges={"a": Bounds(low=1), "b": Bounds(high=1), "c": Bounds(0, 1)})
    row = alone(spark, settings, ('{"a": 0, "b": 2}', 0))[0]
    assert [a.message for a in row.alerts] == ["Field a out of range in tick (0.0 < 1.0)", "Field b out of range in tick (2.0 > 1.0)"]


def test_format(spark):
    cases = {
        '"PX0042"': None, '"PX42"': "PATTERN_MISMATCH", '"PX0042\\n"': "PATTERN_MISMATCH", "null": None, '""': "PATTERN_MISMATCH",
        "42": "NOT_A_STRING", "true": "NOT_A_STRING",
    }
    rows = alone(spark, DEMO_SETTINGS, *[(f'{{"parcel": {c}}}', 0) for c in cases])
    for row, reason in zip(rows, cases.values(), strict=True):
        assert [f'"reason":"{reason}"' in a.evidence_json for a in row.alerts] == ([True] if reason else [])


def test_range_and_format_are_flagged(spark):
    row = alone(spark, DEMO_SETTINGS, ('{"load_kg": 1500, "parcel": "PX42"}', 0))[0]
    assert [a.alert_type for a in row.alerts] == ["FIELD_OUT_OF_RANGE", "FIELD_FORMAT_MISMATCH"] and row.quality_status == "FLAGGED"


def test_parse_formats():
    assert parse_formats(" a = ^x=y$ ,broken,b=z,=q") == {"a": "^x=y$", "b": "z"}
    assert parse_formats("") == {}


def test_iso_duration():
    assert [iso_duration(s) for s in (300, 86400, 0, 90, 0.5)] == ["PT5M", "PT24H", "PT0S", "PT1M30S", "PT0.5S"]


def null_spikes(df, settings):
    observed = schemas.prepare(envelope.enrich(df))
    return sorted(r.seq for r in spikes.null_spikes(spikes.null_runs(observed, settings), settings).where("field_path = 'ask'").collect())


def samples(spark, flags, settings, step=1.0):
    at = lambda k: NOW + timedelta(seconds=step * k)
    return null_spikes(events(spark, *[(f"e{k}", at(k), '{"bid":1}' if f else '{"ask":1,"bid":1}', at(k)) for k, f in enumerate(flags)]), settings)


def test_null_spike(spark):
    assert samples(spark, [0, 1, 1], Settings()) == [2]
    # a rate that has risen before there are enough samples is lost; one that has recovered rises again
    assert samples(spark, [0, 1, 1, 1], Settings(null_threshold=0.4)) == []
    assert samples(spark, [0, 0, 1, 1, 0, 1], Settings(null_threshold=0.49)) == [3, 5]
    assert samples(spark, [0, 0, 1, 1, 0, 1], Settings(null_threshold=0.49), step=40) == []


def test_null_counts_start_anew_with_each_change_of_window(spark):
    at = [NOW, NOW + timedelta(seconds=60), NOW, NOW, NOW]
    null = [0, 0, 1, 1, 1]
    rows = [(f"e{k}", t, '{"bid":1}' if n else '{"ask":1,"bid":1}', NOW + timedelta(seconds=k)) for k, (t, n) in enumerate(zip(at, null, strict=True))]
    for chunk in (1.0, 2.0, 1e6):  # however the order is cut up
        assert null_spikes(events(spark, *rows), Settings(order_chunk=chunk, null_threshold=0.9, null_min_samples=1)) == [2]


def burst(spark, counts, settings=None):
    rows = []
    for w, n in enumerate(counts):
        rows += [(f"e{w}-{i}", NOW + timedelta(minutes=w, seconds=i), f'{{"x":{w * 100 + i}}}', NOW + timedelta(minutes=w, seconds=i)) for i in range(n)]
    return sorted(r.seq for r in spikes.anomaly_spikes(events(spark, *rows), settings or Settings()).collect())


def test_anomaly_spike(spark):
    assert burst(spark, [2, 2, 8]) == [10]
    assert burst(spark, [2, 0, 8]) == []  # too little history
    assert burst(spark, [1, 1, 8]) == []  # crossed below the least count
    assert burst(spark, [2, 2, 6]) == []


def test_null_and_anomaly_alerts_of_the_pipeline(spark):
    rows = [(f"e{k}", NOW + timedelta(seconds=k), '{"bid":%d}' % k if k else '{"ask":1,"bid":1}', NOW + timedelta(seconds=k)) for k in range(3)]
    done = {r.seq: r.alerts for r in process(events(spark, *rows), Settings()).collect()}
    last = [a for a in done[2] if a.alert_type == "NULL_SPIKE"]
    assert [a.message for a in last] == ["Null spike for ask in tick (2/3)"] and '"null_count":2,"total_count":3' in last[0].evidence_json


def test_schema_drift(spark):
    df = events(
        spark,
        ("a", NOW, '{"symbol":"x","bid":1,"ask":2}', NOW),
        ("b", NOW, '{"symbol":"x","bid":"1","spread":2}', NOW),
        ("c", NOW, '{"symbol":"x","bid":null,"ask":2}', NOW),
        ("d", NOW, '{"ask":5.5,"bid":3,"symbol":"y"}', NOW),
    )
    rows = {r.seq: r.alerts for r in process(df, Settings()).collect()}
    drift = [a for a in rows[1] if a.alert_type == "SCHEMA_DRIFT"][0]
    assert drift.field_path == "bid" and drift.message == "Schema drift in tick (missing=1, added=1, type_changed=1)"
    assert '"missing_fields":["ask"],"added_fields":["spread"],"type_changed":{"bid":{"expected":"NUMBER","observed":"STRING"}}' in drift.evidence_json
    assert [a.alert_type for a in rows[2]] == ["SCHEMA_DRIFT"] and rows[0] == [] and rows[3] == []


def test_schema_inference(spark):
    rows = [
        ('{"symbol":"x","bid":1.5,"live":true}', [("bid", "NUMBER"), ("live", "BOOLEAN"), ("symbol", "STRING")]),
        ('{"payload":{"inner":1,"deep":{"a":[1]}},"n":null}', [("n", "NULL"), ("payload", "OBJECT"), ("payload.deep", "OBJECT"), ("payload.deep.a", "ARRAY"), ("payload.inner", "NUMBER")]),
        ("[1,2]", [("<root>", "ARRAY")]),
        ("{}", []),
        ('{"a.b":1,"a":{"b":"x"}}', [("a", "OBJECT"), ("a.b", "NUMBER")]),
    ]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, p string")
    got = {r.k: [tuple(e) for e in r.s] for r in df.select("k", P.schema_entries(F.col("p")).alias("s")).collect()}
    assert got == {k: r[1] for k, r in enumerate(rows)}


def test_payload_hash(spark):
    texts = ['{"a":1,"b":{"y":1,"x":2}}', '{"b":{"x":2,"y":1},"a":1}', '{"a":2,"b":{"y":1,"x":2}}', None, "{}", '{"a":1.0}', '{"a":1}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, p string")
    h = [r.h for r in df.select("k", P.payload_hash(F.col("p")).alias("h")).orderBy("k").collect()]
    assert h[0] == h[1] != h[2] and h[3] == h[4] and h[5] == h[6] and all(len(x) == 64 for x in h)
    s = [r.h for r in df.select("k", P.strict_canonical_json(F.col("p")).alias("h")).orderBy("k").collect()]
    assert s[0] == s[1] != s[2] and s[3] == s[4] and s[5] != s[6]


def fuzzed_json(rng, depth=0):
    """A JSON text at random: odd spaces and strings, repeated keys, numbers of each notation."""
    space = lambda: rng.choice(["", "", " ", "\n", "\t "])
    strings = ["", "a", "b", "a.b", "1.0", "x 2.50 y", 'quote " 1.0', "back\\", '\\"3.0', "\\\\", "\u0001 4.0", "\u0002\u0003\u0004", "line\n", "\u00e9\u4e2d", "{1.5}", "[", "e0"]
    text = lambda: json.dumps(rng.choice(strings), ensure_ascii=rng.random() < 0.5)
    kind = rng.randrange(7 if depth < 3 else 5)
    if kind == 0:
        return text()
    if kind == 1:
        return rng.choice(["0", "-7", "12345678901234567890", "-0"])
    if kind == 2:
        return rng.choice(["0.5", "-1.0", "1.50", "100.000", "2e2", "25E-1", "1.5e+3", "-0.0", "0.001"])
    if kind in (3, 4):
        return rng.choice(["null", "true", "false", "[]", "{}"])
    items = [fuzzed_json(rng, depth + 1) for _ in range(rng.randrange(5))]
    if kind == 5:
        return "[" + ",".join(space() + x + space() for x in items) + "]"
    return "{" + ",".join(space() + text() + space() + ":" + space() + x + space() for x in items) + "}"


def test_strict_canonical_json_equals_plain_python(spark):
    rng = random.Random(5)
    texts = [fuzzed_json(rng) for _ in range(3000)] + ["", "no json", "{1.0", '{"a":1.}', "[01.0]", '{"x":"' + "a\\n\\\"1.0" * 50000 + '","y":2.0}']
    P.allow_repeated_keys(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, p string")
    got = {r.k: r.s for r in df.select("k", P.strict_canonical_json(F.col("p")).alias("s")).collect()}
    for k, text in enumerate(texts):
        try:
            want = json.dumps(json.loads(text or "{}"), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            want = text
        assert got[k] == want, (text[:200], got[k][:200])


def test_validation(spark):
    rows = [("e", "s", "t", NOW, "{}"), (" ", "s", "t", NOW, "{}"), ("e", "s", "t", None, "{}"), ("e", "s", "t", NOW, None), ("", None, "\t\n", None, None)]
    valid, rejected = envelope.validate(spark.createDataFrame(rows, EVENT))
    assert valid.count() == 1
    assert sorted(r.violations for r in rejected.collect()) == [
        "event_id: must not be blank",
        "event_id: must not be blank; source: must not be blank; event_type: must not be blank; event_timestamp: must not be null; payload: must not be null",
        "event_timestamp: must not be null",
        "payload: must not be null",
    ]


def test_own_detector(spark):
    wrong = lambda settings: alerts.where(F.col("event_id") == "e", alerts.alert("CUSTOM", "ERROR", F.lit("m"), F.struct("event_id")))
    done = pipeline.process(events(spark, ("e", NOW, "{}", NOW)), Settings(), [wrong]).collect()[0]
    assert [a.alert_type for a in done.alerts] == ["CUSTOM"] and done.quality_status == "FLAGGED"
    assert "processed" in pipeline.processed_struct(process(events(spark, ("e", NOW, "{}", NOW)), Settings())).columns


def test_empty_input(spark):
    assert process(spark.createDataFrame([], f"{EVENT}, {ARRIVAL}"), DEMO_SETTINGS).count() == 0


EXPECTED = {
    "normal-flow": set(),
    "schema-drift": {"SCHEMA_DRIFT"},
    "duplicate-events": {"DUPLICATE_EVENT"},
    "late-events": {"LATE_EVENT"},
    "null-spike": {"NULL_SPIKE", "SCHEMA_DRIFT"},
    "anomaly-spike": {"ANOMALY_SPIKE"},
    "stale-source": {"LATE_EVENT"},
    "field-range": {"FIELD_OUT_OF_RANGE"},
    "field-format": {"FIELD_FORMAT_MISMATCH"},
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_scenarios(spark, name):
    done = process(scenario(spark, name, NOW), DEMO_SETTINGS)
    kinds = {r.t for r in done.select(F.explode("alerts.alert_type").alias("t")).collect()}
    if name == "anomaly-spike":
        kinds -= {"LATE_EVENT"}
    assert kinds == EXPECTED[name]


def test_mixed_scenario_and_unknown_names(spark):
    kinds = {r.t for r in process(scenario(spark, "mixed-incident", NOW), DEMO_SETTINGS).select(F.explode("alerts.alert_type").alias("t")).collect()}
    assert {"DUPLICATE_EVENT", "LATE_EVENT", "SCHEMA_DRIFT", "NULL_SPIKE", "ANOMALY_SPIKE"} <= kinds
    assert len(SCENARIOS) == 10
    with pytest.raises(ValueError):
        scenario(spark, "no-such", NOW)


def test_events_are_dealt_by_number_and_not_by_type(spark):
    """Few files and few types: events are parsed in all partitions, and no shuffle puts those of a type together."""
    payloads = [json.dumps({"k": k, "v": "x" * (k % 30)} | ({"w": 1} if k % 5 == 0 else {})) for k in range(3000)]
    rows = [(f"e{k}", "s", "t", NOW + timedelta(seconds=k), p, k, NOW + timedelta(seconds=k)) for k, p in enumerate(payloads)]
    few = spark.createDataFrame(rows, f"{EVENT}, {ARRIVAL}").coalesce(1)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "30000")
    try:
        plan = process(few, Settings())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert not re.findall(r"hashpartitioning\((?:coalesce\()?event_type#", plan)
    assert re.findall(r"hashpartitioning\(seq#", envelope.enrich(few)._jdf.queryExecution().executedPlan().toString())


def test_events_are_moved_whole_once_and_schemas_compared_by_kind(spark):
    at = lambda k: NOW + timedelta(seconds=k)
    rows = [(f"e{k}", at(k), '{"ask":1,"bid":1}' if k % 3 else '{"bid":null}', at(k)) for k in range(60)]
    done = process(events(spark, *rows), replace(Settings(), duplicate_window=5))
    found = done.select(F.inline("alerts")).groupBy("alert_type").count().collect()
    assert {r["alert_type"] for r in found} == {"DUPLICATE_EVENT", "SCHEMA_DRIFT"}
    modes = spark._jvm.org.apache.spark.sql.execution.ExplainMode
    plan = done._jdf.queryExecution().explainString(modes.fromString("formatted"))
    moved = [part for part in plan.split("\n\n") if ") Exchange" in part and "payload#" in part]
    assert len(moved) == 1
    assert "map_from_entries" not in plan  # schemas are compared for each type and shape, before
