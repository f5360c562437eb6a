"""The filter's modes and its quality latch in columns: what it says about its fixes, without running it.

Whether a fix counts is an input (``accepted``); all else follows from times and accuracies by windows over a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .navigation import EDGE, Profile


def _windows(keys: list[str], order: list[Column]) -> tuple[WindowSpec, WindowSpec]:
    w = Window.partitionBy(*keys).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)


def quality_latch(rows: DataFrame, keys: list[str], order: list[Column], poor: Column, good: Column, breaks: Column, needed: int, name: str, start: Column | None = None) -> DataFrame:
    """``rows`` with whether the latch is on: ``poor`` rows set it, and ``needed`` ``good`` rows on end release it; rows
    that are neither and ``breaks`` begin the count anew. ``start`` (null but in one row of a key) sets it outright."""
    _, past = _windows(keys, order)
    begin = start.isNotNull() if start is not None else F.lit(False)
    out = rows.withColumns({"_poor": poor & ~begin, "_good": good & ~begin, "_start": start if start is not None else F.lit(None).cast("boolean")})
    out = out.withColumn("_run", F.sum(F.when(F.col("_poor") | breaks | begin, 1).otherwise(0)).over(past))
    run = Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_streak", F.sum(F.col("_good").cast("int")).over(run))
    sets = F.when(F.col("_start").isNotNull(), F.col("_start")).when(F.col("_poor"), True).when(F.col("_good") & (F.col("_streak") >= needed), False)
    return out.withColumn(name, F.coalesce(F.last(sets, ignorenulls=True).over(past), F.lit(False))).drop("_poor", "_good", "_start", "_run", "_streak")


def modes(events: DataFrame, keys: list[str], profile: Profile = EDGE) -> DataFrame:
    """The inertial samples of ``events`` (type, timestamp_ns, sigma, accepted, and others that stay) with ``mode``, and
    with what it comes from: ``fix_age_s``, ``returning`` and ``degraded``.

    An accepted fix more than ``outage_after`` after the last one opens a return, which as many accepted fixes on end as
    the profile asks for close; one that isn't accepted begins their count anew. At equal times samples come first.
    """
    k = profile
    ns, sigma = F.col("timestamp_ns"), F.col("sigma")
    fix = F.col("type") == "gnss"
    order = [ns.asc(), fix.cast("int").asc()]
    before, past = _windows(keys, order)
    counts = F.coalesce(fix & F.col("accepted"), F.lit(False))
    rows = events.withColumn("_counts", counts).withColumn("_last", F.last(F.when(counts, ns), ignorenulls=True).over(before))
    usable = fix & (sigma <= k.accuracy_limit)
    rows = rows.withColumn("_reopen", F.coalesce(usable & (ns - F.col("_last") > k.outage_after * 1e9), F.lit(False)))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_reopen") | (fix & ~F.col("_counts")), 1).otherwise(0)).over(past))
    run = Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_good", F.sum(F.col("_counts").cast("int")).over(run))
    sets = F.when(F.col("_counts") & (F.col("_good") >= k.fixes_to_return), False).when(F.col("_reopen"), True)
    rows = rows.withColumn("returning", F.coalesce(F.last(sets, ignorenulls=True).over(past), F.lit(False)))
    first = F.when(F.col("_counts") & F.col("_last").isNull(), sigma > k.leave_degraded)
    held = F.greatest(F.least(sigma, F.lit(k.accuracy_limit)), F.lit(1.0))
    poor = fix & ((sigma > k.accuracy_limit) | (F.col("_counts") & (held >= k.enter_degraded)))
    good = F.col("_counts") & (held <= k.leave_degraded)
    rows = quality_latch(rows, keys, order, F.coalesce(poor, F.lit(False)), F.coalesce(good, F.lit(False)), F.coalesce(F.col("_counts") & ~good, F.lit(False)), k.streak_to_leave_degraded, "degraded", first)
    rows = rows.withColumn("fix_age_s", (ns - F.last(F.when(F.col("_counts"), ns), ignorenulls=True).over(past)) / 1e9)
    age = F.col("fix_age_s")
    mode = F.when(age.isNull(), "WAITING_FOR_GNSS").when(age > k.outage_after, "DEAD_RECKONING").when(F.col("returning"), "GNSS_REACQUIRING")
    mode = mode.when((age > k.degraded_after) | F.col("degraded"), "GNSS_DEGRADED").otherwise("GNSS_AIDED")
    return rows.where(F.col("type") == "imu").withColumn("mode", mode).drop("_counts", "_last", "_reopen", "_run", "_good")
