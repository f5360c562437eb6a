"""Windows over time and joins of series on the track."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import timeseries as T
from .proxies import RECORDER, TRACK, recorder, track
from .scalars import _r

QUERIES, SQL = {}, {}
D = ["drive"]


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_W = "OVER (PARTITION BY drive ORDER BY t)"


@query(f"WITH {TRACK}, s AS (SELECT event_id, t - lag(t) {_W} AS step FROM track) SELECT event_id, round(step, 5) AS step FROM s WHERE step > 0")
def win1_first_difference(spark, sf):
    return T.steps(track(spark, sf), "t", D, ["t"]).where("step > 0").select("event_id", _r("step", 5).alias("step"))


@query(f"""WITH {TRACK}, s AS (SELECT event_id, drive, t, epoch_us(ts) % 86400000000 / 1e6 AS sod FROM track),
f AS (SELECT *, CASE WHEN sod - lag(sod) {_W} < -43200 THEN 1 ELSE 0 END AS fell FROM s)
SELECT event_id, round(sod + 86400 * sum(fell) OVER (PARTITION BY drive ORDER BY t ROWS UNBOUNDED PRECEDING), 6) AS seconds FROM f""")
def win2_midnight_unwrap(spark, sf):
    rows = track(spark, sf).withColumn("sod", F.col("us") % 86400000000 / 1e6)
    return T.unwrap_day(rows, "sod", D, ["t"]).select("event_id", _r("unwrapped", 6).alias("seconds"))


@query(f"""WITH {TRACK}, a AS (SELECT event_id, drive, t, radians(value * 7) - 2 * pi() * floor((radians(value * 7) + pi()) / (2 * pi())) AS a FROM track),
d AS (SELECT *, a - lag(a) {_W} AS raw FROM a), x AS (SELECT *, coalesce(raw + pi() - 2 * pi() * floor((raw + pi()) / (2 * pi())) - pi() - raw, 0) AS fix FROM d)
SELECT event_id, round(a + sum(fix) OVER (PARTITION BY drive ORDER BY t ROWS UNBOUNDED PRECEDING), 5) AS angle FROM x""")
def win3_phase_unwrap(spark, sf):
    """Angles are wrapped with the SQL's own arithmetic, as the last bit decides which way a half turn goes."""
    from ..functions.scalars import PI

    angle = F.radians(F.col("value") * 7)
    rows = track(spark, sf).withColumn("a", angle - 2 * PI * F.floor((angle + PI) / (2 * PI)))
    return T.unwrap_phase(rows, "a", D, ["t", "event_id"]).select("event_id", _r("unwrapped", 5).alias("angle"))


_SEG = f"seg AS (SELECT event_id, drive, t, value, sum(b) OVER (PARTITION BY drive ORDER BY t ROWS UNBOUNDED PRECEDING) AS segment FROM (SELECT *, CASE WHEN t - lag(t) {_W} <= 0 OR t - lag(t) {_W} > 150000 THEN 1 ELSE 0 END AS b FROM track))"


@query(f"WITH {TRACK}, {_SEG} SELECT event_id, drive, CAST(segment AS BIGINT) AS segment FROM seg")
def win4_gap_segments(spark, sf):
    return T.segments(track(spark, sf), "t", D, F.lit(150000.0)).select("event_id", "drive", "segment")


@query(f"""WITH {TRACK}, g AS (SELECT drive, t - lag(t) {_W} AS dt FROM track), m AS (SELECT drive, greatest(0.25, 2 * quantile_cont(dt, 0.5)) AS gap FROM g WHERE dt > 0 GROUP BY drive),
b AS (SELECT event_id, drive, t, CASE WHEN t - lag(t) {_W} <= 0 OR t - lag(t) {_W} > gap THEN 1 ELSE 0 END AS b FROM track JOIN m USING (drive)),
e AS (SELECT event_id, drive, sum(b) OVER (PARTITION BY drive ORDER BY t ROWS UNBOUNDED PRECEDING) AS episode FROM b),
c AS (SELECT *, count(*) OVER (PARTITION BY drive, episode) AS n FROM e) SELECT event_id, drive, CAST(episode AS BIGINT) AS episode FROM c WHERE n >= 4""")
def win5_episodes(spark, sf):
    return T.episodes(track(spark, sf), "t", D, factor=2.0).select("event_id", "drive", "episode")


def _features_sql(names: list[str], keys: str, order: str, source: str, keep: str, size: int = 20) -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS {size - 1} PRECEDING)"
    cols = ", ".join(f"round(avg({c}) {w}, 9) AS {c}_mean, round(stddev_pop({c}) {w}, 4) AS {c}_std, min({c}) {w} AS {c}_min, max({c}) {w} AS {c}_max, {c} AS {c}_last" for c in names)
    return f"SELECT * EXCLUDE (cnt) FROM (SELECT {keep}, {cols}, count(*) {w} AS cnt FROM {source}) WHERE cnt = {size}"


@query(f"WITH {TRACK}, {_SEG} " + _features_sql(["value"], "drive, segment", "t", "seg", "event_id"))
def win6_rolling_features(spark, sf):
    rows = T.segments(track(spark, sf), "t", D, F.lit(150000.0)).select("event_id", "drive", "segment", "t", "value")
    out = T.rolling_features(rows, ["value"], ["drive", "segment"], ["t"])
    return out.select("event_id", _r("value_mean", 9).alias("value_mean"), _r("value_std", 4).alias("value_std"), "value_min", "value_max", "value_last")


_NORMS = "norms AS (SELECT drive, vec_id, t, " + ", ".join(f"round(sqrt(x[{3 * k + 1}]*x[{3 * k + 1}] + x[{3 * k + 2}]*x[{3 * k + 2}] + x[{3 * k + 3}]*x[{3 * k + 3}]), 6) AS n{k}" for k in range(4)) + " FROM recorder)"


def norms(spark, sf):
    """The four norms of the twelve channels."""
    from ..functions.scalars import norm

    return recorder(spark, sf).select("drive", "vec_id", "t", *[F.round(norm([F.col("x")[3 * k + j] for j in range(3)]), 6).alias(f"n{k}") for k in range(4)])


@query(f"WITH {RECORDER}, {_NORMS} " + _features_sql(["n0", "n1", "n2", "n3"], "drive", "vec_id", "norms", "vec_id"))
def win7_norm_features(spark, sf):
    out = T.rolling_features(norms(spark, sf), ["n0", "n1", "n2", "n3"], D, ["vec_id"])
    return out.select("vec_id", *[_r(c, 9 if c.endswith("mean") else 4).alias(c) if c.endswith(("mean", "std")) else c for c in out.columns if c.startswith("n")])


@query(f"""WITH {TRACK} SELECT event_id, round(CASE WHEN lag(value) {_W} IS NULL THEN (-3 * value + 4 * lead(value) {_W} - lead(value, 2) {_W}) / 0.2
  WHEN lead(value) {_W} IS NULL THEN (3 * value - 4 * lag(value) {_W} + lag(value, 2) {_W}) / 0.2 ELSE (lead(value) {_W} - lag(value) {_W}) / 0.2 END, 5) AS slope FROM track""")
def win8_gradient(spark, sf):
    return T.gradient(track(spark, sf), "value", D, ["t"], 0.1).select("event_id", _r("slope", 5).alias("slope"))


@query(f"""WITH {TRACK}, g AS (SELECT drive, min(t) AS lo, unnest(range(0, CAST(ceil((max(t) + 8640 - min(t)) / 86400) AS BIGINT))) AS tick FROM track GROUP BY drive)
SELECT drive, tick, round(lo + tick * 86400, 4) AS t FROM g""")
def win9_time_grid(spark, sf):
    return T.time_grid(track(spark, sf), "t", D, 86400.0, 0.1).select("drive", "tick", _r("t", 4).alias("t"))


@query(f"""WITH {TRACK}, g AS (SELECT drive, min(t) AS lo, unnest(range(0, CAST(ceil((max(t) + 86400 - min(t)) / 864000) AS BIGINT))) AS tick FROM track GROUP BY drive)
SELECT drive, tick, round(lo + tick * 864000, 3) AS t FROM g""")
def win9_time_grid_in_sql(spark, sf):
    """The same grid, ten days a step, by the table function that ``functions.tables`` registers."""
    from ..functions.tables import register

    register(spark)
    track(spark, sf).groupBy("drive").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).createOrReplaceTempView("spans_of_drives")
    return spark.sql("SELECT s.drive, g.k AS tick, round(g.t, 3) AS t FROM spans_of_drives s, LATERAL time_grid(s.lo, s.hi, double(1 / 864000.0D)) g")


_THROTTLE = "first AS (SELECT *, row_number() OVER (PARTITION BY drive, slot ORDER BY t) AS rn FROM (SELECT *, floor((t - min(t) OVER (PARTITION BY drive)) / 86400) AS slot FROM track))"


@query(f"WITH {TRACK}, {_THROTTLE} SELECT event_id FROM first WHERE rn = 1")
def win10_throttle(spark, sf):
    return T.throttle(track(spark, sf), "t", D, 86400.0).select("event_id")


@query(f"WITH {TRACK}, {_THROTTLE} SELECT event_id FROM first WHERE rn = 1 AND NOT (value >= 10 AND value < 20)")
def win11_outage_clock(spark, sf):
    return T.throttle(track(spark, sf), "t", D, 86400.0).where(~((F.col("value") >= 10) & (F.col("value") < 20))).select("event_id")


@query(f"WITH {TRACK}, b AS (SELECT event_id, sensor, lag(sensor) {_W} AS before FROM track) SELECT event_id, before, sensor FROM b WHERE before <> sensor")
def win12_transitions(spark, sf):
    return T.transitions(track(spark, sf), "sensor", D, ["t"]).select("event_id", "before", "sensor")


@query(f"WITH {TRACK}, r AS (SELECT drive, event_id, row_number() OVER (PARTITION BY drive ORDER BY value DESC, event_id) AS pos FROM track) SELECT drive, event_id, pos FROM r WHERE pos <= 12")
def win13_top_per_key(spark, sf):
    pos = F.row_number().over(Window.partitionBy("drive").orderBy(F.desc("value"), "event_id"))
    return track(spark, sf).select("drive", "event_id", pos.alias("pos")).where("pos <= 12")


@query(f"WITH {TRACK} SELECT event_id, round(sum(value) OVER (PARTITION BY drive ORDER BY t ROWS UNBOUNDED PRECEDING), 4) AS so_far FROM track")
def win14_running_sum(spark, sf):
    w = Window.partitionBy("drive").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return track(spark, sf).select("event_id", _r(F.sum("value").over(w), 4).alias("so_far"))


@query(f"WITH {TRACK} SELECT event_id, round((t - min(t) OVER (PARTITION BY drive)) * 10 * cos(0.5), 4) AS east, round((t - min(t) OVER (PARTITION BY drive)) * 10 * sin(0.5), 4) AS north FROM track")
def win17_constant_speed_track(spark, sf):
    elapsed = F.col("t") - F.min("t").over(Window.partitionBy("drive"))
    return track(spark, sf).select("event_id", _r(elapsed * 10 * F.cos(F.lit(0.5)), 4).alias("east"), _r(elapsed * 10 * F.sin(F.lit(0.5)), 4).alias("north"))


@query(f"WITH {TRACK}, s AS (SELECT drive, value - lag(value) {_W} AS dv FROM track) SELECT drive, count(*) FILTER (WHERE dv <= 0) AS resets FROM s GROUP BY drive")
def win18_timer_resets(spark, sf):
    return T.steps(track(spark, sf), "value", D, ["t"]).groupBy("drive").agg(F.count_if(F.col("step") <= 0).alias("resets"))


@query(f"""WITH {TRACK} SELECT event_id, count(value) OVER w AS n_recent, round(avg(value) OVER w, 5) AS mean_recent FROM track
WINDOW w AS (PARTITION BY drive ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")
def win19_trailing_buffer(spark, sf):
    return T.trailing(track(spark, sf), "value", D, "us", 86400000000).select("event_id", "n_recent", _r("mean_recent", 5).alias("mean_recent"))


_CLICK, _VIEW = "p AS (SELECT * FROM track WHERE sensor = 'click')", "v AS (SELECT * FROM track WHERE sensor = 'view')"


def _two(spark, sf):
    rows = track(spark, sf)
    return rows.where("sensor = 'click'"), rows.where("sensor = 'view'")


@query(f"""WITH {TRACK}, {_CLICK}, {_VIEW}, a AS (SELECT drive, event_id, row_number() {_W} AS r FROM p), b AS (SELECT drive, event_id, row_number() {_W} AS r FROM v)
SELECT a.drive, r, a.event_id AS phone, b.event_id AS vehicle FROM a JOIN b USING (drive, r)""")
def jon1_positional_join(spark, sf):
    p, v = _two(spark, sf)
    out = T.positional_join(p, v, D, ["t"], ["t"])
    return out.select("drive", F.col("row").alias("r"), F.col("event_id").alias("phone"), F.col("r_event_id").alias("vehicle"))


_AROUND = """near AS (SELECT p.event_id, p.t, (SELECT max(v.t) FROM v WHERE v.drive = p.drive AND v.t <= p.t) AS t0, (SELECT min(v.t) FROM v WHERE v.drive = p.drive AND v.t >= p.t) AS t1, p.drive FROM p),
line AS (SELECT n.event_id, n.t0, n.t1, n.t, a.value AS x0, b.value AS x1 FROM near n LEFT JOIN v a ON a.drive = n.drive AND a.t = n.t0 LEFT JOIN v b ON b.drive = n.drive AND b.t = n.t1)"""


@query(f"""WITH {TRACK}, {_CLICK}, {_VIEW}, {_AROUND} SELECT event_id, round(CASE WHEN t1 = t0 THEN x0 ELSE x0 + (x1 - x0) * (t - t0) / (t1 - t0) END, 4) AS x FROM line""")
def jon2_interpolation_join(spark, sf):
    return T.interpolate(*_two(spark, sf), "value", D).select("event_id", _r("interpolated", 4).alias("x"))


@query(f"""WITH {TRACK}, {_CLICK}, {_VIEW}, {_AROUND} SELECT event_id, round(coalesce(CASE WHEN t1 = t0 THEN x0 ELSE x0 + (x1 - x0) * (t - t0) / (t1 - t0) END, x0, x1), 4) AS x FROM line""")
def jon3_clamped_interpolation(spark, sf):
    return T.interpolate(*_two(spark, sf), "value", D, clamp=True).select("event_id", _r("interpolated", 4).alias("x"))


@query(f"""WITH {TRACK}, {_CLICK}, {_VIEW}, a AS (SELECT drive, value, row_number() {_W} AS r FROM p), b AS (SELECT drive, value, row_number() {_W} AS r FROM v),
l AS (SELECT unnest(range(-100, 101)) AS lag) SELECT a.drive, CAST(lag AS INTEGER) AS lag, count(*) AS n, round(corr(a.value, b.value), 5) AS correlation
FROM a, l, b WHERE b.drive = a.drive AND b.r = a.r + lag GROUP BY ALL HAVING count(*) > 2""")
def jon4_lag_sweep(spark, sf):
    return T.lag_sweep(*_two(spark, sf), "value", D, ["t"], 100).where("n > 2").select("drive", "lag", "n", _r("correlation", 5).alias("correlation"))


@query(f"""WITH {TRACK} SELECT a.event_id, (SELECT min_by(b.value, b.t) FROM track b WHERE b.drive = a.drive AND b.t >= a.t + 43200 AND b.t <= a.t + 43200 + 20000) AS later FROM track a""")
def jon5_forward_asof(spark, sf):
    return T.horizon_label(track(spark, sf), "value", D, "t", 43200.0, 20000.0).select("event_id", "later")


@query(f"""WITH {TRACK}, {_CLICK}, {_VIEW} SELECT p.event_id, (SELECT max_by(v.value, v.t) FROM v WHERE v.drive = p.drive AND v.t <= p.t AND v.t >= p.t - 100000) AS latest FROM p""")
def jon10_latest_enrichment(spark, sf):
    return T.latest_before(*_two(spark, sf), "value", D, "t", 100000.0).select("event_id", "latest")


@query(f"""WITH {TRACK} SELECT drive, p.m AS phone, v.m AS vehicle FROM (SELECT drive, max(value) AS m FROM track WHERE sensor = 'click' GROUP BY drive) p JOIN (SELECT drive, max(value) AS m FROM track WHERE sensor = 'view' GROUP BY drive) v USING (drive)""")
def jon11_method_comparison(spark, sf):
    p, v = (d.groupBy("drive").agg(F.max("value").alias(n)) for d, n in zip(_two(spark, sf), ("phone", "vehicle")))
    return p.join(v, "drive")


@query(f"WITH {TRACK} SELECT DISTINCT a.drive FROM track a JOIN track b ON a.drive = b.drive WHERE a.sensor = 'click' AND a.value > 70 AND b.sensor = 'view' AND b.value > 70")
def jon9_file_pairs(spark, sf):
    p, v = (d.where("value > 70").select("drive").distinct() for d in _two(spark, sf))
    return p.join(v, "drive", "left_semi")


@query(f"WITH {TRACK} SELECT DISTINCT drive FROM track WHERE sensor = 'click' AND value > 70 AND drive NOT IN (SELECT drive FROM track WHERE sensor = 'view' AND value > 70)")
def jon12_unpaired(spark, sf):
    p, v = (d.where("value > 70").select("drive").distinct() for d in _two(spark, sf))
    return p.join(v, "drive", "left_anti")


@query(f"""WITH {TRACK}, n AS (SELECT drive, count(*) AS n FROM track GROUP BY drive), r AS (SELECT event_id, drive, row_number() {_W} AS r FROM track) SELECT event_id FROM r JOIN n USING (drive) WHERE (r - 1) % 10 = 0 OR r = n""")
def srt4_downsample(spark, sf):
    w = Window.partitionBy("drive")
    rows = track(spark, sf).select("event_id", F.row_number().over(w.orderBy("t")).alias("r"), F.count("*").over(w).alias("n"))
    return rows.where("(r - 1) % 10 = 0 or r = n").select("event_id")
