"""Aggregations, sorts and set operations on the track."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import timeseries as T
from .proxies import RECORDER, TRACK, recorder, track
from .scalars import _r
from .series import _CLICK, _VIEW, _W, D, _two

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH {TRACK} SELECT drive, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(stddev_pop(value), 6) AS deviation FROM track GROUP BY drive")
def agg1_moments(spark, sf):
    return A.moments(track(spark, sf), "value", D).select("drive", "n", _r("total", 4).alias("total"), _r("mean").alias("mean"), "low", "high", _r("deviation").alias("deviation"))


@query(f"WITH {TRACK} SELECT drive, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS quantile FROM track GROUP BY drive")
def agg2_linear_quantile(spark, sf):
    return A.quantiles(track(spark, sf), "value", D, 0.95).select("drive", _r("median").alias("median"), _r("quantile").alias("quantile"))


@query(f"WITH {TRACK}, l AS (SELECT drive, value, row_number() OVER (PARTITION BY drive ORDER BY t DESC) AS r FROM track) SELECT drive, quantile_disc(value, 0.95) AS quantile FROM l WHERE r <= 512 GROUP BY drive")
def agg3_nearest_rank(spark, sf):
    return A.nearest_rank(track(spark, sf), "value", D, "t", 0.95)


_PAIRS = f"""{TRACK}, {_CLICK}, {_VIEW}, a AS (SELECT drive, t, row_number() {_W} AS r FROM p), b AS (SELECT drive, t, row_number() {_W} AS r FROM v),
pair AS (SELECT a.drive, a.t AS lt, b.t AS rt FROM a JOIN b USING (drive, r))"""


@query(f"""WITH {_PAIRS}, o AS (SELECT drive, quantile_cont(rt - lt, 0.5) AS off FROM pair GROUP BY drive),
d AS (SELECT drive, off, lt, rt, rt - lt - off + 43200 AS x FROM pair JOIN o USING (drive)), e AS (SELECT *, abs(x - 86400 * floor(x / 86400) - 43200) AS rest FROM d)
SELECT drive, round(off, 4) AS offset_s, count(*) AS n, round(quantile_cont(rest, 0.95), 4) AS residual_p95, count(*) FILTER (WHERE rest > 40000) AS bad,
  round(least(max(lt) - min(lt), max(rt) - min(rt)), 4) AS common_duration, quantile_cont(rest, 0.95) <= 40000 AS passed FROM e GROUP BY drive, off""")
def agg4_clock_audit(spark, sf):
    pairs = T.positional_join(*_two(spark, sf), D, ["t"], ["t"])
    out = A.clock_audit(pairs, "t", "r_t", D, 40000.0)
    return out.select("drive", _r("offset", 4).alias("offset_s"), "n", _r("residual_p95", 4).alias("residual_p95"), "bad", _r("common_duration", 4).alias("common_duration"), "passed")


@query(f"""WITH {TRACK}, g AS (SELECT drive, t - lag(t) {_W} AS dt, row_number() OVER (PARTITION BY drive ORDER BY t DESC) AS r FROM track),
m AS (SELECT drive, quantile_cont(dt, 0.5) AS m FROM g WHERE r < 256 AND dt > 0 GROUP BY drive)
SELECT drive, round(m, 4) AS median_step, round(sqrt(avg((dt - m) * (dt - m)) FILTER (WHERE r < 256)), 4) AS jitter, count(*) FILTER (WHERE dt > 1.5 * m) AS gaps FROM g JOIN m USING (drive) WHERE dt > 0 GROUP BY drive, m""")
def agg5_cadence(spark, sf):
    return A.cadence(track(spark, sf), "t", D).select("drive", _r("median_step", 4).alias("median_step"), _r("jitter", 4).alias("jitter"), "gaps")


@query(f"WITH {TRACK}, g AS (SELECT drive, t - lag(t) {_W} AS dt FROM track) SELECT drive, round(min(dt) FILTER (WHERE dt > 0), 4) AS low, round(max(dt) FILTER (WHERE dt > 0), 4) AS high, round(sum(dt) FILTER (WHERE dt > 0) / (count(*) - 1), 4) AS mean FROM g GROUP BY drive")
def agg6_stream_rate(spark, sf):
    return A.stream_rate(track(spark, sf), "t", D).select("drive", *[_r(c, 4).alias(c) for c in ("low", "high", "mean")])


@query(f"""WITH {TRACK}, g AS (SELECT drive, sensor, lag(sensor) {_W} AS before, t - lag(t) {_W} AS dt, t FROM track)
SELECT drive, count(*) AS n, round((count(*) - 1) / (max(t) - min(t)), 9) AS hz, round(quantile_cont(dt, 0.5), 4) AS median_step, count(*) FILTER (WHERE dt > 100000) AS gaps,
  count(*) FILTER (WHERE before <> sensor) AS transitions, count(*) FILTER (WHERE sensor = 'view') AS n_view FROM g GROUP BY drive""")
def agg7_navigation_summary(spark, sf):
    w = Window.partitionBy("drive").orderBy("t")
    rows = track(spark, sf).withColumn("dt", F.col("t") - F.lag("t").over(w)).withColumn("before", F.lag("sensor").over(w))
    return rows.groupBy("drive").agg(
        F.count("*").alias("n"), _r((F.count("*") - 1) / (F.max("t") - F.min("t")), 9).alias("hz"), _r(F.percentile("dt", F.lit(0.5)), 4).alias("median_step"),
        F.count_if(F.col("dt") > 100000).alias("gaps"), F.count_if(F.col("before") != F.col("sensor")).alias("transitions"), F.count_if(F.col("sensor") == "view").alias("n_view"),
    )


_GUESS = f"guess AS (SELECT drive, value AS y, lag(value) {_W} AS g FROM track)"


def _guess(spark, sf):
    return track(spark, sf).select("drive", F.col("value").alias("y"), F.lag("value").over(Window.partitionBy("drive").orderBy("t")).alias("g")).where("g is not null")


@query(f"""WITH {TRACK}, {_GUESS} SELECT drive, round(avg(abs(g - y)), 6) AS mae, round(sqrt(avg((g - y) * (g - y))), 6) AS rmse, round(quantile_cont(abs(g - y), 0.5), 6) AS median_error,
  round(avg(g - y), 6) AS bias, round(1 - sum((g - y) * (g - y)) / (var_pop(y) * count(y)), 6) AS r2, round(corr(y, g), 6) AS correlation FROM guess WHERE g IS NOT NULL GROUP BY drive""")
def agg8_fit_metrics(spark, sf):
    out = A.fit_metrics(_guess(spark, sf), "y", "g", D)
    return out.select("drive", *[_r(c).alias(c) for c in out.columns[1:]])


@query(f"""WITH {TRACK}, {_GUESS}, b(bin, low, high) AS (VALUES (0, 0e0, 2e0), (1, 2e0, 10e0), (2, 10e0, 25e0), (3, 25e0, 60e0))
SELECT CAST(bin AS INTEGER) AS bin, low, high, count(g) AS n, round(avg(abs(g - y)), 6) AS mae FROM b LEFT JOIN (SELECT * FROM guess WHERE g IS NOT NULL) ON y >= low AND y < high GROUP BY ALL""")
def agg9_binned_error(spark, sf):
    return A.binned_error(_guess(spark, sf), "y", "g").select("bin", "low", "high", "n", _r("mae").alias("mae"))


_PLANE = "plane AS (SELECT *, value AS e, CAST(event_id % 1000 AS DOUBLE) AS n, value * 1.1 AS e2, event_id % 1000 + value / 10 AS n2 FROM track)"


def _plane(spark, sf):
    v, k = F.col("value"), F.col("event_id") % 1000
    return track(spark, sf).select("*", v.alias("e"), k.cast("double").alias("n"), (v * 1.1).alias("e2"), (k + v / 10).alias("n2"))


_PATH = f"path AS (SELECT drive, sum(sqrt(de * de + dn * dn)) AS path FROM (SELECT drive, e - lag(e) {_W} AS de, n - lag(n) {_W} AS dn FROM plane) GROUP BY drive)"


@query(f"""WITH {TRACK}, {_PLANE}, {_PATH}, s AS (SELECT drive, max_by(err, t) AS endpoint, max(err) AS largest, sqrt(avg(err * err)) AS rmse FROM (SELECT drive, t, sqrt((e2 - e) * (e2 - e) + (n2 - n) * (n2 - n)) AS err FROM plane) GROUP BY drive)
SELECT drive, round(endpoint, 6) AS endpoint, round(largest, 6) AS largest, round(rmse, 6) AS rmse, round(path, 4) AS path, round(100 * endpoint / path, 8) AS percent, 100 * endpoint / path < 10 AS under_10 FROM s JOIN path USING (drive)""")
def agg10_trajectory_score(spark, sf):
    rows = _plane(spark, sf)
    err = A.hypot(F.col("e2") - F.col("e"), F.col("n2") - F.col("n"))
    out = A.trajectory_score(rows.withColumn("err", err), "err", D, "t", A.path_length(rows, "e", "n", D, "t"))
    return out.select("drive", *[_r(c, k).alias(c) for c, k in (("endpoint", 6), ("largest", 6), ("rmse", 6), ("path", 4), ("percent", 8))], "under_10")


@query(f"""WITH {TRACK}, {_PLANE} SELECT drive, round(sqrt(pow(max_by(e2, t) - min_by(e2, t) - max_by(e, t) + min_by(e, t), 2) + pow(max_by(n2, t) - min_by(n2, t) - max_by(n, t) + min_by(n, t), 2)), 6) AS drift FROM plane GROUP BY drive""")
def agg11_relative_drift(spark, sf):
    return A.relative_drift(_plane(spark, sf), ("e2", "n2"), ("e", "n"), D, "t").select("drive", _r("drift").alias("drift"))


@query(f"WITH {TRACK}, {_PLANE}, {_PATH} SELECT drive, round(path, 4) AS path FROM path")
def agg12_path_length(spark, sf):
    return A.path_length(_plane(spark, sf), "e", "n", D, "t").select("drive", _r("path", 4).alias("path"))


@query(f"""WITH {TRACK}, g AS (SELECT drive, t, t - lag(t) {_W} AS dt FROM track)
SELECT drive, count(*) AS n, round(max(t) - min(t), 4) AS duration, count(*) FILTER (WHERE dt > 50000) AS gaps, round(max(dt), 4) AS longest, round(quantile_cont(dt, 0.5), 4) AS median_step FROM g GROUP BY drive""")
def agg13_track_summary(spark, sf):
    rows = T.steps(track(spark, sf), "t", D, ["t"], "dt")
    return rows.groupBy("drive").agg(F.count("*").alias("n"), _r(F.max("t") - F.min("t"), 4).alias("duration"), F.count_if(F.col("dt") > 50000).alias("gaps"), _r(F.max("dt"), 4).alias("longest"), _r(F.percentile("dt", F.lit(0.5)), 4).alias("median_step"))


@query(f"WITH {TRACK} SELECT split_part(sensor || ':' || (event_id % 7), ':', 1) AS reason, count(*) AS n FROM track GROUP BY ALL")
def agg14_count_by_reason(spark, sf):
    full = F.concat("sensor", F.lit(":"), (F.col("event_id") % 7).cast("string"))
    return track(spark, sf).groupBy(F.split_part(full, F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {TRACK} SELECT sensor AS split, count(DISTINCT drive) AS drives FROM track GROUP BY sensor")
def agg15_distinct_drives(spark, sf):
    return track(spark, sf).groupBy(F.col("sensor").alias("split")).agg(F.count_distinct("drive").alias("drives"))


@query(f"""WITH {RECORDER}, f AS (SELECT vec_id, unnest(range(0, 4)) AS i, unnest(x[1:4]) AS a, x[12] AS y FROM recorder)
SELECT CAST(p.i AS INTEGER) AS i, CAST(q.i AS INTEGER) AS j, round(sum(p.a * q.a), 6) AS value FROM f p JOIN f q USING (vec_id) WHERE p.i <= q.i GROUP BY ALL
UNION ALL SELECT CAST(i AS INTEGER), -1, round(sum(a * y), 6) FROM f GROUP BY i""")
def agg16_gram_matrix(spark, sf):
    rows = recorder(spark, sf).select(*[F.col("x")[k].alias(f"x{k}") for k in range(4)], F.col("x")[11].alias("y"))
    return A.gram(rows, [f"x{k}" for k in range(4)], "y").select("i", "j", _r("value").alias("value"))


@query(f"WITH {TRACK} SELECT drive, max_by(event_id, value * 1e7 - event_id) AS best, min_by(event_id, value * 1e7 + event_id) AS worst FROM track GROUP BY drive")
def agg17_argmax(spark, sf):
    v, k = F.col("value") * 1e7, F.col("event_id")
    return track(spark, sf).groupBy("drive").agg(F.max_by("event_id", v - k).alias("best"), F.min_by("event_id", v + k).alias("worst"))


@query(f"WITH {TRACK} SELECT drive, round(atan2(sum(sin(value)), sum(cos(value))), 6) AS direction, round(sqrt(pow(avg(sin(value)), 2) + pow(avg(cos(value)), 2)), 6) AS concentration FROM track GROUP BY drive")
def agg18_circular_mean(spark, sf):
    return A.circular_mean(track(spark, sf), "value", D).select("drive", _r("direction").alias("direction"), _r("concentration").alias("concentration"))


@query(f"WITH {TRACK} SELECT event_id, round(CASE WHEN count(value) OVER w >= 10 THEN stddev_pop(value) OVER w END, 5) AS vibration FROM track WINDOW w AS (PARTITION BY drive ORDER BY t ROWS 49 PRECEDING)")
def agg19_vibration(spark, sf):
    return A.vibration(track(spark, sf), "value", D, "t").select("event_id", _r("vibration", 5).alias("vibration"))


@query(f"""WITH {TRACK}, m AS (SELECT drive, quantile_cont(value, 0.5) AS m, stddev_pop(value) AS s FROM track GROUP BY drive)
SELECT drive, round(greatest(1.4826 * quantile_cont(abs(value - m), 0.5), 0.25 * s, 1e-3), 6) AS scale FROM track JOIN m USING (drive) GROUP BY drive, s""")
def agg20_robust_scale(spark, sf):
    return A.robust_scale(track(spark, sf), "value", D).select("drive", _r("scale").alias("scale"))


@query(f"WITH {TRACK} SELECT sensor AS split, count(*) AS n, count(DISTINCT drive) AS drives, round(sum(value), 4) AS total FROM track GROUP BY sensor")
def agg21_split_summary(spark, sf):
    return track(spark, sf).groupBy(F.col("sensor").alias("split")).agg(F.count("*").alias("n"), F.count_distinct("drive").alias("drives"), _r(F.sum("value"), 4).alias("total"))


@query(f"WITH {TRACK} SELECT event_id, row_number() OVER (ORDER BY t, event_id) AS pos FROM track")
def srt1_stable_sort(spark, sf):
    return T.positions(track(spark, sf).select("event_id", "t"), ["t", "event_id"]).select("event_id", "pos")


@query(f"WITH {TRACK} SELECT event_id, value FROM track ORDER BY value DESC, event_id LIMIT 10")
def srt2_top_ten(spark, sf):
    return track(spark, sf).orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "value")


@query(f"WITH {TRACK} SELECT drive, count(*) AS n FROM track GROUP BY drive ORDER BY n DESC, min(t) LIMIT 1")
def srt3_longest_trajectory(spark, sf):
    return track(spark, sf).groupBy("drive").agg(F.count("*").alias("n"), F.min("t").alias("first")).orderBy(F.desc("n"), "first").limit(1).select("drive", "n")


@query(f"WITH {TRACK} SELECT event_id, drive, 'real' AS origin FROM track WHERE sensor = 'click' UNION ALL SELECT event_id, drive + 1000000, 'synthetic' FROM track WHERE sensor = 'view'")
def set1_union_with_key_ranges(spark, sf):
    p, v = _two(spark, sf)
    real = p.select("event_id", "drive", F.lit("real").alias("origin"))
    return real.unionByName(v.select("event_id", (F.col("drive") + 1000000).alias("drive"), F.lit("synthetic").alias("origin")))


@query(f"""WITH {TRACK}, r AS (SELECT drive, event_id, value, row_number() OVER (PARTITION BY drive ORDER BY value, event_id) AS r FROM track) SELECT drive, event_id, value FROM r WHERE r = 1 ORDER BY value, event_id LIMIT 12""")
def set3_distinct_by_nearest(spark, sf):
    near = track(spark, sf).groupBy("drive").agg(F.min(F.struct("value", "event_id")).alias("m"))
    return near.select("drive", "m.event_id", "m.value").orderBy("value", "event_id").limit(12)


@query(f"WITH {TRACK} SELECT DISTINCT drive, CAST(floor(value / 30) AS BIGINT) AS cell FROM track")
def set4_cell_union(spark, sf):
    return track(spark, sf).select("drive", F.floor(F.col("value") / 30).alias("cell")).distinct()


@query(f"""WITH {TRACK}, j AS (SELECT sensor, CASE WHEN event_id % 3 = 0 THEN '{{"k":1,"accel":2}}' WHEN event_id % 7 = 0 THEN 'none' ELSE props END AS props FROM track),
m AS (SELECT sensor, unnest(list_filter(['k', 'accel', 'timestamp_s'], lambda c: NOT list_contains(CASE WHEN json_valid(props) THEN json_keys(props) ELSE [] END, c))) AS missing FROM j)
SELECT sensor, missing, count(*) AS n FROM m GROUP BY ALL""")
def set5_missing_columns(spark, sf):
    """Which of the wanted names the records of each sensor lack, and how many of them."""
    from ..functions.tables import missing_keys

    k = F.col("event_id")
    props = F.when(k % 3 == 0, '{"k":1,"accel":2}').when(k % 7 == 0, "none").otherwise(F.col("props"))
    rows = track(spark, sf).select("sensor", F.explode(missing_keys(props, ["k", "accel", "timestamp_s"])).alias("missing"))
    return rows.groupBy("sensor", "missing").agg(F.count("*").alias("n"))
