"""Summaries of series and of fits. Each is one or two keyed aggregations with partial sums."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .timeseries import steps


def moments(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """n, total, mean, low, high and population deviation."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_pop(value).alias("deviation"))


def quantiles(df: DataFrame, value: str, keys: list[str], p: float) -> DataFrame:
    """Median and p-quantile, linear between neighbours."""
    return keyed_quantiles(df, value, keys, {"median": 0.5, "quantile": p})


def last_rows(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def nearest_rank(df: DataFrame, value: str, keys: list[str], order: str, p: float, n: int = 512) -> DataFrame:
    """The p-quantile by nearest rank over the last ``n`` rows."""
    return last_rows(df, keys, order, n).groupBy(*keys).agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias("quantile"))


def cadence(df: DataFrame, time: str, keys: list[str], n: int = 256) -> DataFrame:
    """Over the last ``n`` rows the median step and the root mean square around it; over all rows the steps of more than
    1.5 medians (gaps)."""
    gaps = steps(df, time, keys, [time], "_dt").where("_dt > 0")
    recent = steps(last_rows(df, keys, time, n), time, keys, [time], "_dt").where("_dt > 0")
    middle = recent.groupBy(*keys).agg(F.percentile("_dt", F.lit(0.5)).alias("median_step"))
    joined = recent.join(middle, keys)
    jitter = joined.groupBy(*keys).agg(F.first("median_step").alias("median_step"), F.sqrt(F.avg((F.col("_dt") - F.col("median_step")) ** 2)).alias("jitter"))
    return gaps.join(jitter, keys).groupBy(*keys, "median_step", "jitter").agg(F.count_if(F.col("_dt") > 1.5 * F.col("median_step")).alias("gaps"))


def stream_rate(df: DataFrame, time: str, keys: list[str]) -> DataFrame:
    """Low, high and mean step; the mean is over all steps, also those that don't advance and aren't summed."""
    dt = F.col("_dt")
    return steps(df, time, keys, [time], "_dt").groupBy(*keys).agg(
        F.min(F.when(dt > 0, dt)).alias("low"), F.max(F.when(dt > 0, dt)).alias("high"),
        (F.coalesce(F.sum(F.when(dt > 0, dt)), F.lit(0.0)) / F.nullif(F.count("*") - 1, F.lit(0))).alias("mean"),
    )


def clock_audit(pairs: DataFrame, left: str, right: str, keys: list[str], gate: float, day: float = 86400.0) -> DataFrame:
    """Two clocks of paired rows: median offset, 0.95-quantile of the residuals (wrapped to half a day), rows beyond the
    gate, common duration and whether the pair passes."""
    rows = pairs.withColumn("_offset", F.col(right) - F.col(left))
    middle = rows.groupBy(*keys).agg(F.percentile("_offset", F.lit(0.5)).alias("offset"))
    rest = F.abs(F.pmod(F.col("_offset") - F.col("offset") + day / 2, F.lit(day)) - day / 2)
    return rows.join(middle, keys).withColumn("_rest", rest).groupBy(*keys, "offset").agg(
        F.count("*").alias("n"), F.percentile("_rest", F.lit(0.95)).alias("residual_p95"), F.count_if(F.col("_rest") > gate).alias("bad"),
        (F.least(F.max(left) - F.min(left), F.max(right) - F.min(right))).alias("common_duration"),
    ).withColumn("passed", F.col("residual_p95") <= gate)


def correlation(a: str, b: str) -> Column:
    """Correlation of two columns; null where one of them doesn't vary."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def fit_metrics(df: DataFrame, truth: str, guess: str, keys: list[str]) -> DataFrame:
    """mae, rmse, median absolute error, mean error, r2 (null without spread) and correlation of a prediction."""
    error = F.col(guess) - F.col(truth)
    spread = F.var_pop(truth) * F.count(truth)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.percentile(F.abs(error), F.lit(0.5)).alias("median_error"), F.avg(error).alias("bias"),
        F.when(spread > 0, 1 - F.sum(error * error) / spread).alias("r2"), correlation(truth, guess).alias("correlation"),
    )


#: Speed bins in m/s (fixed values): lower ends in, upper ends out.
BINS = ((0.0, 2.0), (2.0, 10.0), (10.0, 25.0), (25.0, 60.0))


def binned_error(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Rows and mean absolute error in each speed bin; an empty bin has 0 rows and a null error."""
    bins = df.sparkSession.createDataFrame([(k, low, high) for k, (low, high) in enumerate(BINS)], "bin int, low double, high double")
    bin_ = F.lit(None).cast("int")
    for k, (low, high) in enumerate(BINS):
        bin_ = F.when((F.col(truth) >= low) & (F.col(truth) < high), k).otherwise(bin_)
    found = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(guess) - F.col(truth))).alias("mae"))
    return bins.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hypot(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def path_length(df: DataFrame, east: str, north: str, keys: list[str], order: str) -> DataFrame:
    """Sum of the steps of a track on a plane."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = hypot(F.col(east) - F.lag(east).over(w), F.col(north) - F.lag(north).over(w))
    return df.withColumn("_step", step).groupBy(*keys).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path"))


def trajectory_score(df: DataFrame, error: str, keys: list[str], order: str, path: DataFrame) -> DataFrame:
    """Endpoint, largest and root mean square error of a replay, the endpoint as a share of the path and under 10 %."""
    found = df.groupBy(*keys).agg(F.max_by(error, order).alias("endpoint"), F.max(error).alias("largest"), F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse"))
    share = F.when(F.col("path") > 0, 100 * F.col("endpoint") / F.col("path"))
    return found.join(path, keys).withColumn("percent", share).withColumn("under_10", F.coalesce(share < 10, F.lit(False)))


def relative_drift(df: DataFrame, estimate: tuple[str, str], truth: tuple[str, str], keys: list[str], order: str) -> DataFrame:
    """How far the estimate's displacement from first to last row is from the true one."""
    change = lambda c: F.max_by(c, order) - F.min_by(c, order)
    return df.groupBy(*keys).agg(hypot(change(estimate[0]) - change(truth[0]), change(estimate[1]) - change(truth[1])).alias("drift"))


def circular_mean(df: DataFrame, angle: str, keys: list[str]) -> DataFrame:
    """Mean direction and concentration (0: none, 1: all alike)."""
    return df.groupBy(*keys).agg(F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle))).alias("direction"), hypot(F.avg(F.sin(angle)), F.avg(F.cos(angle))).alias("concentration"))


def vibration(df: DataFrame, value: str, keys: list[str], order: str, size: int = 50, least: int = 10) -> DataFrame:
    """Population deviation over the last ``size`` rows, null with fewer than ``least``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, 0)
    return df.withColumn("vibration", F.when(F.count(value).over(w) >= least, F.stddev_pop(value).over(w)))


def robust_scale(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """max(1.4826 * median absolute deviation, a quarter of the deviation, 0.001)."""
    middle = keyed_quantiles(df, value, keys, {"_middle": 0.5})
    rest = df.join(middle, keys).select(*keys, F.abs(F.col(value) - F.col("_middle")).alias("_rest"))
    spread = keyed_quantiles(rest, "_rest", keys, {"_mad": 0.5}).join(df.groupBy(*keys).agg(F.stddev_pop(value).alias("_deviation")), keys)
    return spread.select(*keys, F.greatest(1.4826 * F.col("_mad"), 0.25 * F.col("_deviation"), F.lit(1e-3)).alias("scale"))


def gram(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(i, j, value) of X'X for i <= j, and X'y with j = -1.

    Each task adds up the products of its batches as one small matrix; what is shuffled is a matrix a task, however many
    features there are. Rows with a null count as without that feature, as in sums of products.
    """
    n = len(features)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n + 1))
        for batch in batches:
            x = np.stack([c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            total += x[:, :n].T @ x
        i, j = np.nonzero(np.triu(np.ones((n, n + 1), bool)))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(np.where(j == n, -1, j).astype(np.int32)), pa.array(total[i, j])], ["i", "j", "value"])

    cells = df.select(*[F.col(c).cast("double") for c in (*features, target)]).mapInArrow(products, "i int, j int, value double")
    return cells.groupBy("i", "j").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame, n: int, place: int, small: int) -> float:
    """The value at ``place`` (from 0) of the ``n`` sorted values ``v``."""
    while n > small:
        low, high, marks = rows.agg(F.min("v"), F.max("v"), F.percentile_approx("v", [k / 64 for k in range(65)], 10_000)).first()
        if low == high:
            return low
        cell = F.lit(0)
        for m in sorted({*marks, high}):  # the largest value has a cell for itself, so every pass leaves some rows out
            cell = cell + (F.col("v") >= m).cast("int")
        counts = sorted(tuple(r) for r in rows.groupBy(cell).count().collect())  # 67 rows at most
        for c, size in counts:
            if place < size:
                break
            place -= size
        rows, n = rows.where(cell == c), size
    return rows.orderBy("v").collect()[place]["v"]


#: Rows of a key up to which its values are sorted together, and bins that a larger key's values are counted in.
TOGETHER, BINS_EACH = 10_000, 64


def keyed_quantiles(df: DataFrame, value: str, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each of ``shares``): exact quantiles of each key, linear between neighbours.

    A key with up to TOGETHER rows is sorted by itself. For all larger keys at once counts in bins close in on the rows in
    question: a task sends at most a count for each key and bin, and no key's values are ever held together. Nulls don't
    count; a key without values has null quantiles.
    """
    rows = df.select(F.struct(*keys).alias("_key"), F.col(value).cast("double").alias("_v"))
    sizes = rows.groupBy("_key").agg(F.count("_v").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    large = materialise(sizes.where(F.col("_n") > TOGETHER), "large_keys")
    direct = [F.percentile("_v", F.lit(p)).alias(name) for name, p in shares.items()]
    out = [F.col(f"_key.{k}").alias(k) for k in keys] + [F.col(name) for name in shares]
    if large.isEmpty():
        return rows.groupBy("_key").agg(*direct).select(*out)
    few = rows.join(large.select("_key"), "_key", "left_anti").groupBy("_key").agg(*direct)
    own = materialise(rows.where("_v is not null").join(large.select("_key"), "_key", "left_semi"), "large_rows")
    many = None
    for name, p in shares.items():
        found = _closed_in(own, large, p).withColumnRenamed("_found", name)
        many = found if many is None else many.join(found, "_key")
    return few.unionByName(many).select(*out)


def _closed_in(rows: DataFrame, sizes: DataFrame, p: float) -> DataFrame:
    """(_key, _found): the p-quantile of each key of ``sizes`` (_key, _n, _low, _high)."""
    at = p * (F.col("_n") - 1)
    state = sizes.select("_key", "_low", "_high", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_inside"), F.floor(at).alias("_k"), (at - F.floor(at)).alias("_share"))
    wide = (F.col("_inside") > TOGETHER) & (F.col("_low") < F.col("_high"))
    names = state.columns
    while not state.where(wide).isEmpty():
        near = rows.join(state.where(wide), "_key").where(F.col("_v").between(F.col("_low"), F.col("_high")))
        place = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        bins = near.groupBy("_key", "_below", "_k", "_share", F.least(F.floor(place * BINS_EACH), F.lit(BINS_EACH - 1)).alias("_bin")).agg(F.count("*").alias("_inside"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = F.coalesce(F.sum("_inside").over(Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("_below", F.col("_below") + before).where((F.col("_below") <= F.col("_k")) & (F.col("_k") < F.col("_below") + F.col("_inside")))
        state = materialise(bins.select(*names).unionByName(state.where(~wide)), "closing_in")
    told = rows.join(state, "_key")
    inside = F.col("_v").between(F.col("_low"), F.col("_high")) & (F.col("_low") < F.col("_high"))
    told = told.groupBy(*names).agg(F.sort_array(F.collect_list(F.when(inside, F.col("_v")))).alias("_some"), F.min(F.when(F.col("_v") > F.col("_high"), F.col("_v"))).alias("_next"))
    place = (F.col("_k") - F.col("_below") + 1).cast("int")
    here = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.try_element_at("_some", place))
    after = F.when(F.col("_k") + 1 >= F.col("_below") + F.col("_inside"), F.coalesce("_next", here)).when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.try_element_at("_some", place + 1))
    return told.select("_key", (here + (after - here) * F.col("_share")).alias("_found"))


def spread_quantile(df: DataFrame, value: str, p: float, small: int = 10_000) -> float | None:
    """The exact p-quantile of a whole column, linear between neighbours, without bringing the column together.

    Counts between approximate quantiles close in on a row, until ``small`` rows at most lie between the bounds; only
    these are sorted. Each pass is partial counts of every task. Nulls don't count; no rows, no quantile.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    n = rows.count()
    if not n:
        return None
    place = p * (n - 1)
    low, high = (_ranked(rows, n, k, small) for k in (math.floor(place), math.ceil(place)))
    return low + (high - low) * (place - math.floor(place))
