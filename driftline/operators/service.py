"""What a navigation service tells of each output: place in degrees, age of the fix, the last verdict on a fix, and how
regular its input and output are. The same record in batch and in streams."""

from __future__ import annotations

import math
import time
from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import AXIS
from .folds import carried
from .navigation import EDGE, E, N, Navigator, Profile, clean, event_columns

#: Samples and outputs that rates are taken over, and delays that their 95th percentile is taken of (fixed values).
RECENT, DELAYS = 256, 512
#: Columns of a record. ``line`` is that of the event, where events have one; ``accepted`` answers a fix, ``error`` a bad event.
RECORD = (
    "line long, timestamp_ns long, latitude double, longitude double, east double, north double, speed double, course double, position_sigma double, velocity_sigma double, mode string, fix_age_s double, last_fix_accepted boolean, "
    "samples long, input_hz double, median_step_ms double, jitter_ms double, gaps long, outputs long, output_hz double, delay_p95_ms double, accepted boolean, error string"
)


def _rate(times: deque[int]) -> float | None:
    return (len(times) - 1) * 1e9 / (times[-1] - times[0]) if len(times) > 1 and times[-1] > times[0] else None


class Diagnostics:
    """Counts over all of a source, and rates over its latest samples and outputs."""

    def __init__(self, hz: float) -> None:
        self.hz = hz
        self.times: deque[int] = deque(maxlen=RECENT)
        self.told: deque[int] = deque(maxlen=RECENT)
        self.delays: deque[float] = deque(maxlen=DELAYS)
        self.samples = self.gaps = self.outputs = 0
        self.accepted: bool | None = None

    def sample(self, ns: int) -> None:
        if self.times and ns - self.times[-1] > 1.5e9 / self.hz:
            self.gaps += 1
        self.times.append(ns)
        self.samples += 1

    def output(self, ns: int, delay_ms: float) -> None:
        self.told.append(ns)
        self.delays.append(delay_ms)
        self.outputs += 1

    def record(self) -> dict:
        steps = sorted((b - a) / 1e6 for a, b in zip(self.times, list(self.times)[1:]))
        n = len(steps)
        mean = sum(steps) / n if n else 0.0
        late = sorted(self.delays)
        return {
            "samples": self.samples, "gaps": self.gaps, "outputs": self.outputs, "input_hz": _rate(self.times), "output_hz": _rate(self.told),
            "median_step_ms": (steps[(n - 1) // 2] + steps[n // 2]) / 2 if n else None, "jitter_ms": math.sqrt(sum((s - mean) ** 2 for s in steps) / n) if n else None,
            "delay_p95_ms": late[math.ceil(0.95 * len(late)) - 1] if late else None, "last_fix_accepted": self.accepted,
        }


def served(navigator: Navigator, diagnostics: Diagnostics, events: Iterable[dict]) -> Iterator[dict]:
    """Records of ordered events: outputs, answers to fixes and errors."""
    for event in map(clean, events):
        began = time.perf_counter()
        if event["timestamp_ns"] is None:
            yield {"line": event.get("line"), "error": "timestamp_ns=None is not in [0, inf]"}
            continue
        said = navigator.step(event["type"], event)
        ns = event["timestamp_ns"]
        if said is not None and "error" in said:
            yield {"line": event.get("line"), **said}
            continue
        if event["type"] == "imu":
            diagnostics.sample(ns)
        if said is None:
            continue
        if "accepted" in said:
            diagnostics.accepted = said["accepted"]
            yield {"line": event.get("line"), **said}
            continue
        diagnostics.output(ns, (time.perf_counter() - began) * 1e3)
        yield {"line": event.get("line"), **placed(navigator, said), **diagnostics.record()}


def placed(navigator: Navigator, said: dict) -> dict:
    """An output in degrees around the first accepted fix; without one there is no place."""
    fix, known = navigator.fix_clock, navigator.origin is not None
    out = {k: said[k] for k in ("timestamp_ns", "speed", "position_sigma", "velocity_sigma", "mode")}
    out |= {"course": (90 - math.degrees(said["heading"])) % 360, "fix_age_s": max(0, said["timestamp_ns"] - fix) / 1e9 if fix is not None else None}
    if known:
        lat0, lon0 = navigator.origin
        out |= {"east": said["east"], "north": said["north"], "latitude": lat0 + math.degrees(navigator.x[N] / AXIS), "longitude": lon0 + math.degrees(navigator.x[E] / (AXIS * math.cos(math.radians(lat0))))}
    return out


def service_order() -> list[Column]:
    """Events of a source in the order in which they count."""
    return [F.col("timestamp_ns"), F.when(F.col("type") == "start", 0).when(F.col("type") == "imu", 1).otherwise(2)]


def with_line(events: DataFrame, source: str) -> DataFrame:
    """The filter's columns, and ``line`` (null where events have none)."""
    line = F.col("line").cast("long") if "line" in events.columns else F.lit(None).cast("long")
    return event_columns(events.withColumn("line", line), source, "line")


def serve(events: DataFrame, source: str = "source_id", profile: Profile = EDGE, hz: float = 200.0) -> DataFrame:
    """(source, RECORD) of all events of each source, by time; ``hz`` is the nominal rate of samples, from which gaps are
    told. Fixes come in degrees (latitude, longitude), as the service takes them."""
    rows = with_line(events, source)
    return carried(rows, [source], service_order(), lambda: (profile.navigator(), Diagnostics(hz)), lambda state, part, done: served(*state, part), RECORD)
