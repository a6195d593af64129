"""Settings of the detectors and of source health, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

MINUTE = 60.0
HOUR = 3600.0


@dataclass(frozen=True)
class Bounds:
    """Inclusive bounds of a numeric field; either may be open."""

    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Settings:
    """Durations are in seconds."""

    duplicate_window: float = 5 * MINUTE
    late_threshold: float = 5 * MINUTE
    window_size: float = MINUTE
    null_threshold: float = 0.6
    null_min_samples: int = 3
    anomaly_windows: int = 2
    anomaly_min_history: int = 2
    anomaly_ratio: float = 3.0
    anomaly_min_count: int = 5
    ranges: dict[str, Bounds] = field(default_factory=dict)
    formats: dict[str, str] = field(default_factory=dict)
    stale_after: float = 5 * MINUTE
    stale_after_rss: float = 30 * MINUTE
    stale_after_pipeline: float = 24 * HOUR
    incident_window: float = 5 * MINUTE
    short_look_back: float = 5 * MINUTE
    long_look_back: float = HOUR
    #: Stretch of arrival time that one task handles of a key whose rows depend on the row before.
    order_chunk: float = 24 * HOUR


#: The field checks of the demonstration events.
DEMO_SETTINGS = Settings(ranges={"load_kg": Bounds(0, 900)}, formats={"parcel": "^PX[0-9]{4}$"})


def parse_formats(spec: str) -> dict[str, str]:
    """'field=regex,field=regex' as a dict in order; entries without '=' or without a name are left out."""
    found = {}
    for entry in spec.split(","):
        name, equals, pattern = entry.partition("=")
        if equals and name.strip() and pattern.strip():
            found[name.strip()] = pattern.strip()
    return found


def iso_duration(seconds: float) -> str:
    """ISO-8601 text of a duration, in hours, minutes and seconds."""
    whole = int(seconds)
    parts = [(whole // 3600, "H"), (whole % 3600 // 60, "M")]
    text = "".join(f"{n}{unit}" for n, unit in parts if n)
    rest = whole % 60 + (seconds - whole)
    if rest or not text:
        text += f"{rest:g}S"
    return "PT" + text
