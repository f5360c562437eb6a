"""Dead reckoning under outages: benchmarks that replay the filter over recordings and score what it says."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import heading_to_course, normal
from .aggregates import hypot, path_length, trajectory_score
from .navigation import EDGE, Profile, replay

#: Noise of the synthetic recorder (fixed values): spreads of the biases and of each sample, and of fixes in metres.
ACCEL_BIAS, RATE_BIAS, ACCEL_NOISE, RATE_NOISE, FIX_NOISE = 0.04, 0.001, 0.08, 0.002, 3.0


def outage_events(truth: DataFrame, source: str, start_s: float, duration_s: float, fix_period_s: float = 1.0, seed: int = 20260928) -> DataFrame:
    """Events of a noisy recorder on a true track (``timestamp_ns``, ``east``, ``north``, ``speed``, ``heading``, ``accel``,
    ``yaw_rate``): all its samples, and a fix at the first sample of each period outside the outage.

    Noise follows from the source, the time and the seed, so it is the same however rows are dealt out. Periods go on
    through the outage: the fixes that it swallows don't come later.
    """
    t0 = F.min("timestamp_ns").over(Window.partitionBy(source))
    rows = truth.withColumn("t", (F.col("timestamp_ns") - t0) / 1e9)
    own = lambda salt, *more: normal(F.lit(seed), F.lit(salt), F.col(source), *more)
    ns = F.col("timestamp_ns")
    imu = rows.select(
        source, F.lit("imu").alias("type"), "timestamp_ns", (F.col("accel") + ACCEL_BIAS * own(1) + ACCEL_NOISE * own(2, ns)).alias("accel"), (F.col("yaw_rate") + RATE_BIAS * own(3) + RATE_NOISE * own(4, ns)).alias("yaw_rate"),
        F.lit(1.0).alias("quality"), (F.col("speed") > 1).alias("driving"), (F.col("speed") < 0.3).alias("stationary"),
    )
    slot = F.floor((F.col("t") + 1e-8) / fix_period_s)
    first = F.row_number().over(Window.partitionBy(source, "slot").orderBy("timestamp_ns"))
    due = rows.withColumn("slot", slot).withColumn("first", first).where("first = 1")
    due = due.where(~((F.col("t") >= start_s) & (F.col("t") < start_s + duration_s)))
    fixes = due.select(
        source, F.lit("gnss").alias("type"), "timestamp_ns", (F.col("east") + FIX_NOISE * own(5, ns)).alias("east"), (F.col("north") + FIX_NOISE * own(6, ns)).alias("north"),
        F.lit(max(1.0, FIX_NOISE)).alias("sigma"), "speed", heading_to_course(F.col("heading")).alias("course"),
    )
    return imu.unionByName(fixes, allowMissingColumns=True)


def outage_benchmark(truth: DataFrame, source: str, start_s: float, duration_s: float, fix_period_s: float = 1.0, seed: int = 20260928, profile: Profile = EDGE) -> DataFrame:
    """For each source what the filter says during an outage, against the truth: rmse, largest error, drift of the
    displacement, the true distance, drift in percent of it, fixes tried and accepted. States are those behind the fixes
    of their time. A source whose outage has no sample gives no row."""
    events = outage_events(truth, source, start_s, duration_s, fix_period_s, seed)
    said = replay(events, source, replace(profile, tell_fixes=True), after_fixes=True)
    fixes = said.where("accepted is not null").groupBy(source).agg(F.count("*").alias("fixes"), F.count_if(F.col("accepted")).alias("accepted"))
    t0 = F.min("timestamp_ns").over(Window.partitionBy(source))
    known = truth.withColumn("t", (F.col("timestamp_ns") - t0) / 1e9).where((F.col("t") >= start_s) & (F.col("t") < start_s + duration_s))
    known = known.select(source, "timestamp_ns", F.col("east").alias("true_e"), F.col("north").alias("true_n"))
    both = said.where("error is null and accepted is null").select(source, "timestamp_ns", "east", "north").join(known, [source, "timestamp_ns"])
    error = hypot(F.col("east") - F.col("true_e"), F.col("north") - F.col("true_n"))
    step = Window.partitionBy(source).orderBy("timestamp_ns")
    leg = hypot(F.col("true_e") - F.lag("true_e").over(step), F.col("true_n") - F.lag("true_n").over(step))
    change = lambda c: F.max_by(c, "timestamp_ns") - F.min_by(c, "timestamp_ns")
    found = both.withColumn("error", error).withColumn("leg", leg).groupBy(source).agg(
        F.count("*").alias("samples"), F.sqrt(F.avg(F.col("error") ** 2)).alias("rmse"), F.max("error").alias("largest"),
        hypot(change("east") - change("true_e"), change("north") - change("true_n")).alias("drift"), F.coalesce(F.sum("leg"), F.lit(0.0)).alias("distance"),
    )
    return found.withColumn("percent", F.when(F.col("distance") > 0, 100 * F.col("drift") / F.col("distance"))).join(fixes, source, "left")


#: The methods of an outage replay, and which inputs each uses (fixed values).
METHODS = {
    "imu_no_nhc": {"driving": False}, "imu_nhc": {}, "gyro_only_constant_speed": {"accel": 0.0},
    "imu_nhc_speed_model": {"change": True}, "imu_nhc_portable_speed": {"learned": True},
}


def outage_methods(rows: DataFrame, source: str) -> DataFrame:
    """Each way of dead reckoning over an outage, side by side: endpoint, largest and mean square error, percent of path.

    ``rows`` are the samples inside the outage: ``timestamp_ns``, ``accel``, ``yaw_rate``, ``quality``, the reference
    ``ref_e``, ``ref_n``, ``ref_speed``, ``ref_course``, and for learned speeds ``learned_speed``, ``learned_variance``,
    ``learned_out_of_range``, ``speed_change``, ``change_variance``, ``horizon_s`` (null where there is none). Every method
    starts from the reference's first place, speed and course and gets no fix. "constant_speed" goes straight on.
    """
    first = rows.groupBy(source).agg(F.min(F.struct("timestamp_ns", "ref_e", "ref_n", F.greatest("ref_speed", F.lit(0.0)).alias("speed"), F.col("ref_course").alias("course"))).alias("s"))
    rows = rows.join(first, source)
    learned, change = ("learned_speed", "learned_variance", "learned_out_of_range"), ("speed_change", "change_variance", "horizon_s")
    one = []
    for name, uses in METHODS.items():
        own = {"method": F.lit(name), "accel": F.lit(uses["accel"]) if "accel" in uses else F.col("accel"), "driving": F.lit(uses.get("driving", True))}
        own |= {c: F.col(c) if uses.get("learned") else F.lit(None).cast(rows.schema[c].dataType) for c in learned}
        own |= {c: F.col(c) if uses.get("change") else F.lit(None).cast(rows.schema[c].dataType) for c in change}
        one.append(F.struct(*[c.alias(k) for k, c in own.items()]))
    each = rows.select(source, "timestamp_ns", "yaw_rate", "quality", F.explode(F.array(*one)).alias("m"))
    imu = each.select(source, F.lit("imu").alias("type"), "timestamp_ns", "yaw_rate", "quality", "m.*", F.lit(False).alias("stationary"))
    begin = first.select(source, F.explode(F.array(*map(F.lit, METHODS))).alias("method"), F.lit("start").alias("type"), "s.timestamp_ns", F.lit(0.0).alias("east"), F.lit(0.0).alias("north"), F.lit(1.0).alias("sigma"), "s.speed", "s.course")
    said = replay(imu.unionByName(begin, allowMissingColumns=True), [source, "method"]).where("error is null").select(source, "method", "timestamp_ns", "east", "north")
    ahead = (F.col("timestamp_ns") - F.col("s.timestamp_ns")) / 1e9 * F.col("s.speed")
    straight = rows.select(source, F.lit("constant_speed").alias("method"), "timestamp_ns", (ahead * F.sin(F.radians("s.course"))).alias("east"), (ahead * F.cos(F.radians("s.course"))).alias("north"))
    truth = rows.select(source, "timestamp_ns", (F.col("ref_e") - F.col("s.ref_e")).alias("true_e"), (F.col("ref_n") - F.col("s.ref_n")).alias("true_n"))
    both = said.unionByName(straight).join(truth, [source, "timestamp_ns"])
    both = both.withColumn("error", hypot(F.col("east") - F.col("true_e"), F.col("north") - F.col("true_n")))
    path = path_length(truth, "true_e", "true_n", [source], "timestamp_ns")
    path = path.withColumn("method", F.explode(F.array(*map(F.lit, ("constant_speed", *METHODS)))))
    return trajectory_score(both, "error", [source, "method"], "timestamp_ns", path)
