"""Filters and checks. All are plans over columns; those that look back need the order of rows named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .aggregates import keyed_quantiles, spread_quantile


def valid_position(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows with finite coordinates in range; NaN compares above all numbers, so it fails the range as well."""
    return df.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))


def in_interval(t: Column, low: Column, high: Column, closed: bool) -> Column:
    """A time in [low, high], or in [low, high) if not closed."""
    return (t >= low) & ((t <= high) if closed else (t < high))


def drop_repeated_times(df: DataFrame, time: str, keys: list[str], order: list[str], least: float = 1e-6) -> DataFrame:
    """Rows whose time is more than ``least`` after the row before them (kept or not); the first row of a key stays."""
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(time) - F.col("_before") > least)).drop("_before")


def not_increasing(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Rows that don't pass the row before them: to be rejected or set apart."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_before", before).where(F.col(value) <= F.col("_before")).drop("_before")


def valid_fix(lat: Column, lon: Column, sigma: Column, ns: Column, before_ns: Column, sigma_limit: float = 35.0) -> Column:
    """A position fix within the range of the projection, of bounded uncertainty, later than the one before."""
    later = before_ns.isNull() | (ns > before_ns)
    return lat.between(-85, 85) & lon.between(-180, 180) & (sigma > 0) & (sigma <= sigma_limit) & (ns > 0) & later


def every_nth(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key and every n-th from there."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).where((F.col("_at") - 1) % n == 0).drop("_at")


def sensor_rows(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows of the wanted sensors, and those that name none."""
    return df.where((F.trim(column) == "") | F.col(column).isin(wanted))


def compatible_rates(df: DataFrame, time: str, keys: list[str], tolerance: float) -> DataFrame:
    """For each key its median ``hz`` and whether it lies within a share ``tolerance`` of the median of all keys."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    steps = keyed_quantiles(df.withColumn("_dt", step).where("_dt > 0"), "_dt", keys, {"_middle": 0.5})
    rates = steps.select(*keys, (1 / F.col("_middle")).alias("hz"))
    rates = materialise(rates, "rates")
    middle = spread_quantile(rates, "hz", 0.5)
    return rates.withColumn("compatible", F.abs(F.col("hz") / F.lit(middle) - 1) <= tolerance)


def misplaced(df: DataFrame, which: Column, split: str, allowed: str) -> DataFrame:
    """Rows of a kind that stand in another split than the allowed one; there should be none."""
    return df.where(which & (F.col(split) != allowed))


def rotation_problem(matrix: list[list[float]], tolerance: float = 1e-4) -> str | None:
    """Why a matrix is not a proper rotation, or None."""
    import numpy as np

    m = np.array(matrix, float)
    if m.shape != (3, 3) or not np.isfinite(m).all():
        return "rotation must be a finite 3 x 3 matrix"
    if np.abs(m @ m.T - np.eye(3)).max() > tolerance:
        return "rotation must be orthonormal"
    return None if abs(np.linalg.det(m) - 1) <= tolerance else "rotation must have determinant 1"


def softmax(df: DataFrame, score: str, keys: list[str], name: str) -> DataFrame:
    """Shares of exp(score) within each key; exponents stop at -700."""
    w = Window.partitionBy(*keys)
    raised = df.withColumn(name, F.exp(F.greatest(F.lit(-700.0), F.col(score) - F.max(score).over(w))))
    return raised.withColumn(name, F.col(name) / F.sum(name).over(w))
