"""Demonstration events of a parcel depot, each set made to raise one kind of alert."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from plumbline.model import ARRIVAL, EVENT


@dataclass(frozen=True)
class Reading:
    """An event `at` seconds from now; readings of one label share the event id."""

    label: str
    at: float = 0.0
    sensor: str = "gate"
    kind: str = "scan"
    values: dict = field(default_factory=lambda: {"lane": 4, "belt": "north", "load_kg": 12.5})


def steady(_: datetime) -> Iterator[Reading]:
    for k in range(5):
        yield Reading(f"steady{k}", 2.0 * k, "dock", "weighing", {"lane": k, "load_kg": 10.0 + k})


def changed_shape(_: datetime) -> Iterator[Reading]:
    """A field turns from a number to a text, one goes and one comes."""
    yield Reading("shape-first", kind="survey", values={"lane": 1, "height_mm": 310, "width_mm": 200})
    yield Reading("shape-second", kind="survey", values={"lane": 2, "height_mm": "310", "depth_mm": 90})


def sent_again(_: datetime) -> Iterator[Reading]:
    for _k in range(2):
        yield Reading("again")


def delayed(_: datetime) -> Iterator[Reading]:
    yield Reading("delayed", -1500.0, values={"lane": 9, "belt": "south"})


def lost_field(_: datetime) -> Iterator[Reading]:
    """The first reading has a temperature, the following ones a null."""
    for k, celsius in enumerate([4.5, None, None, None]):
        yield Reading(f"lost{k}", 1.0 * k, "cold-room", "climate", {"lane": k, "celsius": celsius})


def rush(now: datetime) -> Iterator[Reading]:
    """Three readings in each of two minutes, then ten in one; within whole minutes, whatever the time is now."""
    start = -float(now.second) - now.microsecond / 1e6
    for minute, n in ((-2, 3), (-1, 3), (0, 10)):
        for k in range(n):
            yield Reading(f"rush{minute}-{k}", start + 60 * minute + k, "sorter", "pass", {"lane": 100 * minute + k})


def silent_sensor(_: datetime) -> Iterator[Reading]:
    yield Reading("silent", -2400.0, "back-door", values={"lane": 7})


def overload(_: datetime) -> Iterator[Reading]:
    yield Reading("overload", kind="weighing", values={"load_kg": 950.0, "parcel": "PX0042"})


def misprint(_: datetime) -> Iterator[Reading]:
    yield Reading("misprint", kind="weighing", values={"load_kg": 3.0, "parcel": "PX42"})


def bad_day(now: datetime) -> Iterator[Reading]:
    for part in (sent_again, delayed, changed_shape, lost_field, rush, silent_sensor):
        yield from part(now)


#: The kinds of alert, and what raises them.
SCENARIOS: dict[str, Callable[[datetime], Iterator[Reading]]] = {
    "normal-flow": steady,
    "schema-drift": changed_shape,
    "duplicate-events": sent_again,
    "late-events": delayed,
    "null-spike": lost_field,
    "anomaly-spike": rush,
    "stale-source": silent_sensor,
    "field-range": overload,
    "field-format": misprint,
    "mixed-incident": bad_day,
}


def scenario(spark: SparkSession, name: str, now: datetime, trace: str = "t1") -> DataFrame:
    """The events of a scenario as a batch; all arrive now, or at their own time where that is later.

    trace keeps runs apart: it is in the event ids, and in the names of the sources that a scenario has alone.
    """
    if name not in SCENARIOS:
        raise ValueError(f"unknown scenario: {name}")
    rows = []
    for seq, r in enumerate(SCENARIOS[name](now)):
        at = now + timedelta(seconds=r.at)
        source = r.sensor if r.sensor == "gate" else f"{r.sensor}/{trace}"
        rows.append((f"{trace}:{r.label}", source, f"depot.{r.kind}", at, json.dumps(r.values | {"run": trace}), seq, max(now, at)))
    return spark.createDataFrame(rows, f"{EVENT}, {ARRIVAL}")
