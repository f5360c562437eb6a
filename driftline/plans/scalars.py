"""Scalar functions and filters on the track."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters as L
from .proxies import RECORDER, TRACK, recorder, table, track

QUERIES, SQL = {}, {}


def query(sql: str):
    """Registers a query with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _r(c, n=6):
    return F.round(c, n)


@query(f"WITH {TRACK} SELECT event_id, round((value - 50 + pi()) - 2 * pi() * floor((value - 50 + pi()) / (2 * pi())) - pi(), 6) AS wrapped FROM track")
def sca1_wrap_angle(spark, sf):
    return track(spark, sf).select("event_id", _r(S.wrap(F.col("value") - 50)).alias("wrapped"))


@query(f"""WITH {TRACK}, h AS (SELECT event_id, value, pi() / 2 - radians(value * 7) + pi() AS h FROM track)
SELECT event_id, round(h - 2 * pi() * floor(h / (2 * pi())) - pi(), 6) AS heading,
  round(90 - degrees(value) - 360 * floor((90 - degrees(value)) / 360), 6) AS course FROM h""")
def sca2_course_heading(spark, sf):
    v = F.col("value")
    return track(spark, sf).select("event_id", _r(S.course_to_heading(v * 7)).alias("heading"), _r(S.heading_to_course(v)).alias("course"))


@query(f"WITH {TRACK}, d AS (SELECT event_id, value * 9 - event_id % 360 + 180 AS d FROM track) SELECT event_id, round(abs(d - 360 * floor(d / 360) - 180), 6) AS gap FROM d")
def sca3_heading_gap(spark, sf):
    return track(spark, sf).select("event_id", _r(S.heading_gap(F.col("value") * 9, F.col("event_id") % 360)).alias("gap"))


_HAV = "pow(sin(radians(lat - 51.5) / 2), 2) + cos(radians(51.5)) * cos(radians(lat)) * pow(sin(radians(lon + 0.12) / 2), 2)"


@query(f"WITH {TRACK}, a AS (SELECT event_id, {_HAV} AS a FROM track) SELECT event_id, round(2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)), 3) AS metres FROM a")
def sca4_haversine(spark, sf):
    return track(spark, sf).select("event_id", _r(S.haversine(F.lit(51.5), F.lit(-0.12), F.col("lat"), F.col("lon")), 3).alias("metres"))


@query(f"WITH {TRACK}, a AS (SELECT event_id, {_HAV} AS a FROM track) SELECT event_id, round(2 * 6371000 * asin(sqrt(least(greatest(a, 0), 1))), 3) AS metres FROM a")
def sca5_haversine_clipped(spark, sf):
    return track(spark, sf).select("event_id", _r(S.haversine_clipped(F.lit(51.5), F.lit(-0.12), F.col("lat"), F.col("lon")), 3).alias("metres"))


@query(f"""WITH {TRACK}, p AS (SELECT event_id, radians(lon + 0.12) * 6378137 * cos(radians(51.5)) AS e, radians(lat - 51.5) * 6378137 AS n FROM track)
SELECT event_id, round(e, 4) AS east, round(n, 4) AS north, round(51.5 + degrees(n / 6378137), 8) AS lat,
  round(-0.12 + degrees(e / (6378137 * greatest(1e-6, cos(radians(51.5))))), 8) AS lon FROM p""")
def sca6_local_plane(spark, sf):
    lat0, lon0 = F.lit(51.5), F.lit(-0.12)
    e, n = S.to_local(F.col("lat"), F.col("lon"), lat0, lon0)
    lat, lon = S.from_local(e, n, lat0, lon0)
    return track(spark, sf).select("event_id", _r(e, 4).alias("east"), _r(n, 4).alias("north"), _r(lat, 8).alias("lat"), _r(lon, 8).alias("lon"))


@query(f"WITH {TRACK}, b AS (SELECT event_id, degrees(atan2(value - 50, event_id % 97 - 48.5)) AS b FROM track) SELECT event_id, round(b - 360 * floor(b / 360), 6) AS bearing FROM b")
def sca7_bearing(spark, sf):
    return track(spark, sf).select("event_id", _r(S.bearing(F.col("value") - 50, F.col("event_id") % 97 - 48.5)).alias("bearing"))


@query(f"""WITH {TRACK}, m AS (SELECT event_id, (lon + 180) / 360 * 8388608 AS x, (0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 8388608 AS y FROM track)
SELECT event_id, round(x, 3) AS x, round(y, 3) AS y, CAST(floor(x / 256) AS BIGINT) AS tile_x, CAST(floor(y / 256) AS BIGINT) AS tile_y,
  round(degrees(atan(sinh(pi() * (1 - 2 * y / 8388608)))), 7) AS lat, round(x / 8388608 * 360 - 180, 7) AS lon FROM m""")
def sca8_web_mercator(spark, sf):
    x, y = S.mercator_pixel(F.col("lat"), F.col("lon"), 15)
    lat, lon = S.mercator_inverse(x, y, 15)
    return track(spark, sf).select("event_id", _r(x, 3).alias("x"), _r(y, 3).alias("y"), F.floor(x / 256).alias("tile_x"), F.floor(y / 256).alias("tile_y"), _r(lat, 7).alias("lat"), _r(lon, 7).alias("lon"))


@query(f"""WITH {TRACK} SELECT event_id, round(value * CASE sensor WHEN 'view' THEN 9.80665 WHEN 'click' THEN pi() / 180 WHEN 'error' THEN 1 / 3.6 WHEN 'purchase' THEN 1e-3 END, 8) AS base FROM track""")
def sca9_unit_scaling(spark, sf):
    unit = F.when(F.col("sensor") == "view", "g").when(F.col("sensor") == "click", "deg/s").when(F.col("sensor") == "error", "km/h").when(F.col("sensor") == "purchase", "ms").otherwise("?")
    return track(spark, sf).select("event_id", _r(S.in_base_unit(F.col("value"), unit), 8).alias("base"))


def _vectors():
    return [F.col("x")[k] for k in range(3)], [F.col("x")[k] for k in range(3, 6)]


@query(f"""WITH {RECORDER}, v AS (SELECT vec_id, x, sqrt(x[1]*x[1] + x[2]*x[2] + x[3]*x[3]) AS n FROM recorder)
SELECT vec_id, round(n, 5) AS norm, round(x[1]*x[4] + x[2]*x[5] + x[3]*x[6], 5) AS dot, round(x[2]*x[6] - x[3]*x[5], 5) AS cross_x,
  round(x[3]*x[4] - x[1]*x[6], 5) AS cross_y, round(x[1]*x[5] - x[2]*x[4], 5) AS cross_z, round(x[1] / greatest(n, 1e-9), 5) AS unit_x FROM v""")
def sca10_vector_algebra(spark, sf):
    a, b = _vectors()
    c = S.cross(a, b)
    return recorder(spark, sf).select("vec_id", _r(S.norm(a), 5).alias("norm"), _r(S.dot(a, b), 5).alias("dot"), *[_r(x, 5).alias(f"cross_{n}") for x, n in zip(c, "xyz")], _r(S.unit(a)[0], 5).alias("unit_x"))


@query(f"WITH {RECORDER} SELECT vec_id, round(-x[2], 5) AS rx, round(x[1], 5) AS ry, round(x[3], 5) AS rz FROM recorder")
def sca11_rotation(spark, sf):
    a, _ = _vectors()
    turned = S.rotate(S.rotation_zyx(0.0, 0.0, S.PI / 2), a)
    return recorder(spark, sf).select("vec_id", *[(_r(x, 5) + 0.0).alias(f"r{n}") for x, n in zip(turned, "xyz")])


@query(f"""WITH {TRACK} SELECT event_id, hour(ts) * 3600.0::DOUBLE + minute(ts) * 60.0::DOUBLE + round(epoch_us(ts) % 60000000 / 1e6, 6) AS seconds,
  regexp_extract(strftime(ts, '%Y-%m-%d %H:%M:%S:%g'), ':([0-9]+)$', 1) AS millis FROM track""")
def sca15_seconds_of_day(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss:SSS")
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss:SSS"))
    return track(spark, sf).select("event_id", S.seconds_of_day(F.col("ts")).alias("seconds"), F.lpad(F.date_format(parsed, "SSS"), 3, "0").alias("millis"))


@query(f"""WITH {TRACK}, f AS (SELECT event_id, sensor || event_id AS name FROM track)
SELECT event_id, regexp_extract(name, '^([a-z]+)', 1) AS driver, CASE WHEN name[1] = 'v' THEN 'Vw' WHEN name[1] = 's' THEN 'S' ELSE 'other' END AS family,
  CASE WHEN event_id % 10 < 6 THEN 'train' WHEN event_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split FROM f""")
def sca14_drive_family(spark, sf):
    name = F.concat("sensor", F.col("event_id").cast("string"))
    shown = F.regexp_replace(F.regexp_replace(name, "^v", "Vw"), "^s", "S")
    part = F.col("event_id") % 10
    split = F.when(part < 6, "train").when(part < 8, "validation").otherwise("test")
    return track(spark, sf).select("event_id", F.regexp_extract(name, "^([a-z]+)", 1).alias("driver"), S.drive_family(shown).alias("family"), split.alias("split"))


@query(f"WITH {TRACK} SELECT event_id, least(greatest(value - 20, 0), 60) AS clipped FROM track")
def sca16_clip(spark, sf):
    return track(spark, sf).select("event_id", S.clip(F.col("value") - 20, 0.0, 60.0).alias("clipped"))


@query(f"""WITH {TRACK}, s AS (SELECT event_id, drive, exp(greatest(-700, value - max(value) OVER (PARTITION BY drive))) AS e FROM track)
SELECT event_id, round(e / sum(e) OVER (PARTITION BY drive), 9) AS share FROM s""")
def sca17_softmax(spark, sf):
    return L.softmax(track(spark, sf), "value", ["drive"], "share").select("event_id", _r("share", 9).alias("share"))


@query("SELECT page_id, contains(lower(html), 'news') AS hit FROM pages")
def sca18_substring_match(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.contains_ignoring_case(F.col("html"), "NEWS").alias("hit"))


@query(f"""WITH {TRACK}, f AS (SELECT event_id, value AS e, CAST(event_id % 100 AS DOUBLE) AS n, least(greatest((value * 60 + (event_id % 100) * 80) / 10000, 0), 1) AS f FROM track)
SELECT event_id, round(f, 6) AS fraction, round(f * 60, 6) AS east, round(f * 80, 6) AS north, round(sqrt((e - f*60)*(e - f*60) + (n - f*80)*(n - f*80)), 6) AS distance FROM f""")
def sca19_point_to_segment(spark, sf):
    found = S.project_to_segment(F.col("value"), (F.col("event_id") % 100).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(60.0), F.lit(80.0))
    return track(spark, sf).select("event_id", *[_r(c).alias(n) for c, n in zip(found, ("fraction", "east", "north", "distance"))])


@query(f"""WITH {TRACK}, d AS (SELECT event_id, event_id * 37 % 360 - 180 AS d FROM track)
SELECT event_id, CASE WHEN abs(d) >= 150 THEN 'U-turn' WHEN d >= 30 THEN 'Turn right' WHEN d <= -30 THEN 'Turn left' ELSE 'Continue' END AS say FROM d""")
def sca20_turn_instruction(spark, sf):
    return track(spark, sf).select("event_id", S.turn_instruction(F.col("event_id") * 37 % 360 - 180).alias("say"))


@query(f"WITH {TRACK} SELECT event_id, CASE WHEN value > 30 THEN '{{\"k\":null,\"v\":1}}' ELSE '{{\"k\":' || json_extract_string(props, '$.k') || ',\"v\":1}}' END AS js FROM track")
def sca22_json_nulls(spark, sf):
    k = F.when(F.col("value") <= 30, F.get_json_object("props", "$.k").cast("int"))
    return track(spark, sf).select("event_id", F.to_json(F.struct(k.alias("k"), F.lit(1).alias("v")), {"ignoreNullFields": "false"}).alias("js"))


@query(f"""WITH {TRACK}, s AS (SELECT drive, bool_or(sensor = 'view') AS a, bool_or(sensor = 'click') AS g, bool_or(value > 60) AS v FROM track GROUP BY drive)
SELECT drive, CASE WHEN a AND g AND v THEN 'full' WHEN a AND g THEN 'degraded' ELSE 'gnss_only' END AS profile FROM s""")
def sca23_capability_profile(spark, sf):
    has = track(spark, sf).groupBy("drive").agg(F.bool_or(F.col("sensor") == "view").alias("a"), F.bool_or(F.col("sensor") == "click").alias("g"), F.bool_or(F.col("value") > 60).alias("v"))
    return has.select("drive", S.capability_profile(F.col("a"), F.col("g"), F.col("v")).alias("profile"))


@query(f"WITH {TRACK} SELECT event_id, lat, lon FROM track WHERE isfinite(lat) AND isfinite(lon) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -0.115 AND 180")
def flt1_finite_in_range(spark, sf):
    return L.valid_position(track(spark, sf)).where("lon >= -0.115").select("event_id", "lat", "lon")


@query(f"""WITH {TRACK}, b AS (SELECT drive, min(t) + 3600 AS lo, min(t) + 90000 AS hi FROM track GROUP BY drive)
SELECT event_id, t BETWEEN lo AND hi AS closed, t >= lo AND t < hi AS half_open FROM track JOIN b USING (drive) WHERE t BETWEEN lo AND hi""")
def flt2_interval_mask(spark, sf):
    rows = track(spark, sf)
    spans = rows.groupBy("drive").agg((F.min("t") + 3600).alias("lo"), (F.min("t") + 90000).alias("hi"))
    t, lo, hi = F.col("t"), F.col("lo"), F.col("hi")
    out = rows.join(spans, "drive").where(L.in_interval(t, lo, hi, closed=True))
    return out.select("event_id", L.in_interval(t, lo, hi, closed=True).alias("closed"), L.in_interval(t, lo, hi, closed=False).alias("half_open"))


@query(f"""WITH {TRACK}, g AS (SELECT *, floor(t / 3600) AS hour, lag(floor(t / 3600)) OVER (PARTITION BY drive ORDER BY t, event_id) AS before FROM track)
SELECT event_id, drive, CAST(hour AS BIGINT) AS hour FROM g WHERE before IS NULL OR hour - before > 1e-6""")
def flt3_drop_duplicate_times(spark, sf):
    rows = track(spark, sf).withColumn("hour", F.floor(F.col("t") / 3600))
    return L.drop_repeated_times(rows, "hour", ["drive"], ["t", "event_id"]).select("event_id", "drive", "hour")


@query(f"""WITH {TRACK}, g AS (SELECT event_id, drive, value, lag(value) OVER (PARTITION BY drive ORDER BY t) AS before FROM track)
SELECT event_id, drive, value FROM g WHERE value <= before""")
def flt4_not_increasing(spark, sf):
    return L.not_increasing(track(spark, sf), "value", ["drive"], ["t"]).select("event_id", "drive", "value")


@query(f"""WITH {TRACK}, g AS (SELECT event_id, us * 1000 AS ns, lat, lon, value AS sigma, lag(us * 1000) OVER (PARTITION BY drive ORDER BY us) AS before FROM track)
SELECT event_id, lat BETWEEN -85 AND 85 AND lon BETWEEN -180 AND 180 AND sigma > 0 AND sigma <= 35 AND ns > 0 AND (before IS NULL OR ns > before) AS valid FROM g""")
def flt6_gnss_event_validity(spark, sf):
    rows = track(spark, sf).withColumn("ns", F.col("us") * 1000)
    before = F.lag("ns").over(Window.partitionBy("drive").orderBy("us"))
    return rows.select("event_id", L.valid_fix(F.col("lat"), F.col("lon"), F.col("value"), F.col("ns"), before).alias("valid"))


@query(f"WITH {TRACK} SELECT event_id, sensor FROM track WHERE sensor <> 'error' AND value < 60")
def flt7_split_and_quality(spark, sf):
    return track(spark, sf).where((F.col("sensor") != "error") & (F.col("value") < 60)).select("event_id", "sensor")


@query(f"""WITH {TRACK}, n AS (SELECT event_id, value, row_number() OVER (PARTITION BY drive ORDER BY t) AS pos FROM track)
SELECT event_id, value FROM n WHERE (pos - 1) % 2 = 0 AND value BETWEEN 0 AND 60""")
def flt8_every_second_valid_label(spark, sf):
    return L.every_nth(track(spark, sf), 2, ["drive"], ["t"]).where(F.col("value").between(0, 60)).select("event_id", "value")


@query(f"WITH {TRACK} SELECT event_id, sensor FROM track WHERE trim(sensor) = '' OR sensor IN ('view', 'click')")
def flt9_sensor_rows(spark, sf):
    return L.sensor_rows(track(spark, sf), "sensor", ["view", "click"]).select("event_id", "sensor")


@query(f"""WITH {TRACK}, g AS (SELECT drive, t - lag(t) OVER (PARTITION BY drive ORDER BY t) AS dt FROM track), r AS (SELECT drive, 1 / quantile_cont(dt, 0.5) AS hz FROM g WHERE dt > 0 GROUP BY drive)
SELECT drive, abs(hz / (SELECT quantile_cont(hz, 0.5) FROM r) - 1) <= 0.05 AS compatible FROM r""")
def flt10_rate_compatibility(spark, sf):
    return L.compatible_rates(track(spark, sf), "t", ["drive"], 0.05).select("drive", "compatible")


@query(f"WITH {TRACK} SELECT event_id FROM track WHERE sensor = 'signup' AND event_id % 10 >= 6")
def flt11_synthetic_train_only(spark, sf):
    split = F.when(F.col("event_id") % 10 < 6, "train").otherwise("test")
    return L.misplaced(track(spark, sf).withColumn("split", split), F.col("sensor") == "signup", "split", "train").select("event_id")


@query(f"WITH {TRACK} SELECT drive, count(DISTINCT sensor) AS n_splits FROM track GROUP BY drive HAVING count(DISTINCT sensor) > 4")
def flt12_one_split_per_drive(spark, sf):
    return track(spark, sf).groupBy("drive").agg(F.count_distinct("sensor").alias("n_splits")).where("n_splits > 4")
