"""External inertial recorders: from a device's units, axes and clock to the vehicle's, and how regular its samples are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import UNITS, rotate
from .filters import rotation_problem

#: Nanoseconds of a time unit (fixed values).
NANOSECONDS = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}


@dataclass(frozen=True)
class Recorder:
    """How a device measures. ``rotation`` takes its axes to forward, left, up; ``gravity`` is what it shows at rest, for
    devices whose samples don't say; both in the device's axes, biases too."""

    acceleration_unit: str = "m/s2"
    rate_unit: str = "rad/s"
    time_unit: str = "s"
    offset_ns: int = 0
    rotation: tuple[tuple[float, ...], ...] = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    acceleration_bias: tuple[float, ...] = (0.0, 0.0, 0.0)
    rate_bias: tuple[float, ...] = (0.0, 0.0, 0.0)
    without_gravity: bool = False
    gravity: tuple[float, ...] | None = None
    hz: float = 200.0

    def __post_init__(self) -> None:
        wrong = rotation_problem([list(r) for r in self.rotation])
        for name, unit, known in (("acceleration", self.acceleration_unit, ("m/s2", "g")), ("rate", self.rate_unit, ("rad/s", "deg/s")), ("time", self.time_unit, tuple(NANOSECONDS))):
            if unit not in known:
                wrong = f"unknown {name} unit {unit}"
        if not self.hz > 0:
            wrong = "the rate of samples must be positive"
        if self.without_gravity and self.gravity is not None:
            wrong = "samples without gravity can't have it taken off"
        if wrong:
            raise ValueError(wrong)


def _finite(v: Column) -> Column:
    good = v.isNotNull() & (F.size(v) == 3)
    for k in range(3):
        good = good & F.coalesce(F.abs(v[k]) < float("inf"), F.lit(False))
    return good


def converted(samples: DataFrame, recorder: Recorder) -> DataFrame:
    """``samples`` (time, acceleration, angular_rate, gravity or null) with ``timestamp_ns``, ``accel`` (forward) and
    ``yaw_rate`` (about the vertical), or with an ``error`` in their place; in batch or stream.

    In this order: units, biases, gravity, axes. Time must be finite, and not negative behind the offset.
    """
    a_unit, r_unit = UNITS[recorder.acceleration_unit], UNITS[recorder.rate_unit]
    force = [F.col("acceleration")[k] * a_unit - b for k, b in enumerate(recorder.acceleration_bias)]
    rate = [F.col("angular_rate")[k] * r_unit - b for k, b in enumerate(recorder.rate_bias)]
    own = F.array(*map(F.lit, recorder.gravity)) if recorder.gravity else F.lit(None).cast("array<double>")
    pull = F.coalesce("gravity", own)
    if not recorder.without_gravity:
        force = [f - pull[k] for k, f in enumerate(force)]
    rows = [list(r) for r in recorder.rotation]
    ns = F.round(F.col("time") * NANOSECONDS[recorder.time_unit]).cast("long") + recorder.offset_ns
    error = F.when(~F.coalesce(F.abs("time") < float("inf"), F.lit(False)), "time must be finite").when(ns < 0, "time is negative behind the offset")
    error = error.when(~_finite(F.col("acceleration")), "acceleration needs three finite values").when(~_finite(F.col("angular_rate")), "angular rate needs three finite values")
    if not recorder.without_gravity:
        error = error.when(pull.isNull(), "gravity is unknown for a sample that includes it").when(~_finite(pull), "gravity needs three finite values")
    good = F.col("error").isNull()
    out = samples.withColumn("error", error).withColumn("timestamp_ns", F.when(good, ns))
    return out.withColumn("accel", F.when(good, rotate(rows, force)[0])).withColumn("yaw_rate", F.when(good, rotate(rows, rate)[2]))


def normalised(samples: DataFrame, recorder: Recorder, source: str = "source_id") -> DataFrame:
    """``converted`` samples, where a time must also be later than those of all good samples before it of its source, in
    the order of ``position`` if there is such a column, else of time."""
    out = converted(samples, recorder)
    before = Window.partitionBy(source).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_at", F.col("position") if "position" in samples.columns else F.col("time"))
    late = F.col("timestamp_ns") <= F.max("timestamp_ns").over(before)
    out = out.withColumn("error", F.coalesce("error", F.when(late, "times must increase"))).drop("_at")
    return out.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("timestamp_ns", "accel", "yaw_rate")})


def diagnostics(samples: DataFrame, outputs: DataFrame, hz: float, source: str = "source_id", time: str = "timestamp_ns", last: int = 256) -> DataFrame:
    """For each source: samples and outputs, gaps (steps over 1.5 nominal ones), and over the last ``last`` samples the
    measured rate, the median step and the root mean square around the mean step, in milliseconds; the rate of outputs."""
    w = Window.partitionBy(source).orderBy(time)
    rows = samples.select(source, time, (F.col(time) - F.lag(time).over(w)).alias("_step"), F.row_number().over(Window.partitionBy(source).orderBy(F.desc(time))).alias("_back"))
    recent, step = F.col("_back") <= last, F.when(F.col("_back") < last, F.col("_step") / 1e6)
    rate = lambda near, t: (F.count_if(near) - 1) * 1e9 / F.nullif(F.max(F.when(near, t)) - F.min(F.when(near, t)), F.lit(0))
    found = rows.groupBy(source).agg(
        F.count("*").alias("samples"), F.count_if(F.col("_step") > 1.5e9 / hz).alias("gaps"), rate(recent, F.col(time)).alias("input_hz"),
        F.percentile(step, F.lit(0.5)).alias("median_step_ms"), F.stddev_pop(step).alias("jitter_ms"),
    )
    told = outputs.select(source, time, F.row_number().over(Window.partitionBy(source).orderBy(F.desc(time))).alias("_back"))
    told = told.groupBy(source).agg(F.count("*").alias("outputs"), rate(F.col("_back") <= last, F.col(time)).alias("output_hz"))
    return found.join(told, source, "left").withColumn("outputs", F.coalesce("outputs", F.lit(0)))
