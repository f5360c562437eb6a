"""Folds over signals on proxies; they depend on order and state. SQL states the short ones by recursion over the rows of a
drive, and the tests hold the others against stated cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import signals as G
from .proxies import TRACK, track

QUERIES, SQL = {}, {}


def query(f=None, sql: str = ""):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep if f is None else keep(f)


#: The rows of ``_rows`` that SQL needs, numbered within their drive.
_SIGNALS = f"""{TRACK}, n AS (SELECT drive, event_id AS id, (us - min(us) OVER (PARTITION BY drive)) / 3.6e10 AS t, value, CASE WHEN event_id % 5 = 0 THEN 0.2e0 ELSE 0.8e0 END AS quality, value AS e, CAST(event_id % 100 AS DOUBLE) AS n,
  row_number() OVER (PARTITION BY drive ORDER BY us) AS i FROM track)"""


def _rows(spark, sf):
    """An hour of the track counts as a tenth of a second."""
    k, v = F.col("event_id"), F.col("value")
    t = (F.col("us") - F.min("us").over(Window.partitionBy("drive"))) / 3.6e10
    return track(spark, sf).select(
        "drive", k.alias("id"), t.alias("t"), v.alias("value"), F.when(k % 5 == 0, 0.2).otherwise(0.8).alias("quality"), ((k % 360) / 57.0).alias("azimuth"), ((k % 360) / 57.0 + 0.5 + (k % 7) / 50.0).alias("course"),
        (v / 20).alias("accel"), ((k % 21) / 200).alias("gyro"), ((k % 21) / 150).alias("vertical"), F.when(k % 3 == 0, 1.0).alias("fix_age"), F.lit(5.0).alias("accuracy"), (v / 5).alias("speed"), v.alias("e"), ((k % 100) * 1.0).alias("n"),
    )


@query(sql=f"""WITH RECURSIVE {_SIGNALS}, v AS (SELECT *, least(greatest(value, -12), 12) AS x FROM n), r(drive, i, id, t, smooth) AS (SELECT drive, i, id, t, CAST(x AS DOUBLE) FROM v WHERE i = 1
UNION ALL SELECT v.drive, v.i, v.id, v.t, CASE WHEN v.t - r.t > 0.25 THEN v.x ELSE r.smooth + (1 - exp(-2 * pi() * CASE WHEN v.quality < 0.4 THEN 1.5e0 ELSE 4e0 END * greatest(v.t - r.t, 0))) * (v.x - r.smooth) END FROM r JOIN v ON v.drive = r.drive AND v.i = r.i + 1)
SELECT drive, id, round(smooth, 6) AS smooth FROM r""")
def sca21_low_pass(spark, sf):
    out = G.folded(_rows(spark, sf).select("drive", "id", "t", "value", "quality"), ["drive"], ["t"], G.low_pass, "id long, smooth double")
    return out.select("drive", "id", F.round("smooth", 6).alias("smooth"))


@query
def sta12_motion_classes(spark, sf):
    return G.folded(_rows(spark, sf), ["drive"], ["t"], G.MotionClass, "id long, event string, quality double, stationary boolean, driving boolean, bias double")


@query
def sta13_yaw_alignment(spark, sf):
    return G.folded(_rows(spark, sf).select("drive", "id", "t", "course", "azimuth"), ["drive"], ["t"], G.YawAlignment, "id long, offset double, confidence double, moved boolean")


_LEGS = ((0.0, 0.0, 40.0, 0.0), (40.0, 0.0, 40.0, 60.0), (40.0, 60.0, 100.0, 60.0))


def _guidance_sql() -> str:
    """Each leg's distance and place along the route, and progress by recursion."""
    legs = ", ".join(f"({k}, {a}e0, {b}e0, {c}e0, {d}e0, {x}e0)" for k, ((a, b, c, d), x) in enumerate(zip(_LEGS, (0, 40, 100))))
    f = "least(greatest(((e - ae) * (be - ae) + (n - an) * (bn - an)) / (pow(be - ae, 2) + pow(bn - an, 2)), 0), 1)"
    return f"""WITH RECURSIVE {_SIGNALS}, l AS (SELECT drive, id, i, leg, before + f * sqrt(pow(be - ae, 2) + pow(bn - an, 2)) AS along, sqrt(pow(e - ae - f * (be - ae), 2) + pow(n - an - f * (bn - an), 2)) AS off FROM (SELECT *, {f} AS f FROM n, (VALUES {legs}) AS legs(leg, ae, an, be, bn, before))),
v AS (SELECT drive, id, i, list(struct_pack(off := off, leg := leg, along := along) ORDER BY off, leg) AS near FROM l GROUP BY ALL),
r(drive, i, id, progress, deviation) AS (SELECT drive, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0e0, 0e0 FROM (SELECT DISTINCT drive FROM v)
UNION ALL SELECT drive, i, id, CASE WHEN best.off <= 60 THEN greatest(progress, best.along) ELSE progress END, best.off FROM (SELECT v.drive, v.i, v.id, r.progress, list_filter(v.near, lambda x: x.along >= r.progress - 15)[1] AS best FROM r JOIN v ON v.drive = r.drive AND v.i = r.i + 1))
SELECT drive, id, round(progress, 6) AS progress, round(greatest(0, 160 - progress), 6) AS remaining, round(coalesce(deviation, 'infinity'), 6) AS deviation FROM r WHERE i > 0"""


@query(sql=_guidance_sql())
def sta18_guidance(spark, sf):
    out = G.folded(_rows(spark, sf).select("drive", "id", "t", "e", "n"), ["drive"], ["t", "id"], lambda: G.Guidance(list(_LEGS)), "id long, progress double, remaining double, deviation double")
    return out.select("drive", "id", *[F.round(c, 6).alias(c) for c in ("progress", "remaining", "deviation")])


@query(sql=f"""WITH RECURSIVE {_SIGNALS}, r(drive, i, id, t, last, told) AS (SELECT drive, i, id, t, t, TRUE FROM n WHERE i = 1
UNION ALL SELECT n.drive, n.i, n.id, n.t, CASE WHEN n.t - r.last < 0.5 THEN r.last ELSE n.t END, n.t - r.last >= 0.5 FROM r JOIN n ON n.drive = r.drive AND n.i = r.i + 1)
SELECT drive, id, round(t, 6) AS t FROM r WHERE told""")
def sta19_rate_limit(spark, sf):
    out = G.folded(_rows(spark, sf).select("drive", "id", "t"), ["drive"], ["t"], lambda: G.rate_limit(0.5), "id long, t double")
    return out.select("drive", "id", F.round("t", 6).alias("t"))


@query
def sim1_synthetic_recorder(spark, sf):
    rows = _rows(spark, sf).select("drive", "t", (F.col("n") * 3.6).alias("angle"), (F.col("value") / 10).alias("speed"))
    return G.synthesise(rows, "drive", 10.0)


@query
def sta14_mount_calibration(spark, sf):
    """When a mount's rotation is known and how sure: a device turned by a right angle, fixes once a second; an event's
    value is the acceleration over a second, and speeds are what these add up to."""
    from ..operators.signals import CalibrationFold

    past = Window.partitionBy("drive").orderBy("us", "event_id")
    pull = F.least(F.greatest((F.col("value") - 20) / 12, F.lit(-3.0)), F.lit(3.0))  # of the second that an event stands for
    rows = track(spark, sf).select("drive", (F.row_number().over(past) - 1).cast("long").alias("k"), pull.alias("pull"))
    so_far = F.sum("pull").over(Window.partitionBy("drive").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("speed", 40 + F.coalesce(so_far, F.lit(0.0)))
    rows = rows.select("drive", "k", "pull", "speed", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("part")).withColumn("tick", F.col("k") * 10 + F.col("part"))
    rows = rows.select("drive", F.col("tick").alias("id"), (F.col("tick") * 100_000_000).alias("ns"), F.lit(0.0).alias("ax"), F.col("pull").alias("ay"), F.when(F.col("part") == 0, F.col("speed")).alias("speed"))
    return G.folded(rows, ["drive"], ["ns"], CalibrationFold, "id long, ready boolean, confidence double, forward double")
