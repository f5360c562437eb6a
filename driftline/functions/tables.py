"""Functions to call from SQL text: ``register`` gives a session the table functions time_grid and route_legs and the
function network_speed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

#: The last time of a grid may lie this share of a step behind the end (fixed value).
OVER = 0.1


@udtf(returnType="k bigint, t double")
class TimeGrid:
    """(k, t) of the uniform grid from ``start`` in steps of 1 / ``hz`` up to ``stop``; a null or a step that is not
    positive gives no row."""

    def eval(self, start: float, stop: float, hz: float) -> Iterator[tuple[int, float]]:
        if start is None or stop is None or hz is None or not hz > 0:
            return
        dt = 1 / hz
        for k in range(max(0, math.ceil((stop + OVER * dt - start) / dt))):
            yield k, start + k * dt


@udtf(returnType="leg int, start_e double, start_n double, end_e double, end_n double, length double, bearing double, so_far double, say string")
class RouteLegs:
    """The legs between the points (arrays of east and north) of a route, with what to say at each; equal neighbours are
    one point."""

    def eval(self, e: list[float], n: list[float]) -> Iterator[tuple]:
        points = [p for k, p in enumerate(zip(e or [], n or [])) if k == 0 or p != (e[k - 1], n[k - 1])]
        so_far, before = 0.0, None
        for leg, (a, b) in enumerate(zip(points, points[1:]), 1):
            length = math.hypot(b[0] - a[0], b[1] - a[1])
            bearing = math.degrees(math.atan2(b[0] - a[0], b[1] - a[1])) % 360
            change = 0.0 if before is None else (bearing - before + 540) % 360 - 180
            say = "Start" if before is None else "U-turn" if abs(change) >= 150 else "Turn right" if change >= 30 else "Turn left" if change <= -30 else "Continue"
            so_far, before = so_far + length, bearing
            yield leg, *a, *b, length, bearing, so_far, say


def network_speed(model: dict):
    """A vectorised function of arrays of features: the speed that ``model`` (see ``operators.models``) gives, in m/s."""
    w1, b1, w2 = (np.array(model[k], float) for k in ("w1", "b1", "w2"))
    mean, scale = np.array(model["mean"], float), np.array(model["scale"], float)

    @pandas_udf("double")
    def speed(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=float)
        z = np.clip((np.stack(features.to_numpy()).astype(float) - mean) / scale, -8, 8)
        out = np.tanh(z @ w1 + b1) @ w2 + model["b2"]
        return pd.Series(np.clip(out * model["target_scale"] + model["target_mean"], 0, 60))

    return speed


def register(spark: SparkSession, model: dict | None = None) -> None:
    spark.udtf.register("time_grid", TimeGrid)
    spark.udtf.register("route_legs", RouteLegs)
    if model is not None:
        spark.udf.register("network_speed", network_speed(model))


def missing_keys(text: Column, wanted: list[str]) -> Column:
    """The wanted names that a JSON object lacks, in the order asked; all of them where the text is no object."""
    have = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    return F.array_except(F.array(*map(F.lit, wanted)), have)
