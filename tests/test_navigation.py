"""The filter, latches, graphs, models, sources and streams against stated cases and round trips."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pytest
from driftline.operators import filters, models, navigation, roads
from driftline.operators.navigation import HANDHELD, Navigator, Rejected
from driftline.sources import logs, maps
from driftline.streaming import navigation as stream
from pyspark.sql import functions as F


def scenario():
    """12 s at 200 Hz, fixes driving north at 10 m/s with an outage from 1 s to 8 s."""
    rows = []
    for k in range(2401):
        ns = 1 + k * 5_000_000
        rows.append({"source_id": "a", "type": "imu", "timestamp_ns": ns, "accel": 0.0, "yaw_rate": 0.0, "quality": 1.0, "driving": True, "stationary": False})
        if k in (0, 200, 1600, 1800, 2000, 2200, 2400):
            rows.append({"source_id": "a", "type": "gnss", "timestamp_ns": ns, "east": 0.0, "north": k * 0.05, "sigma": 4.0, "speed": 10.0, "course": 0.0})
    return pd.DataFrame(rows)


def imu(ns, **more):
    return {"timestamp_ns": ns, "accel": 0.0, "yaw_rate": 0.0, "quality": 1.0, "driving": False, "stationary": False} | more


def test_learned_speeds_are_admitted_once_a_second_from_good_samples():
    n, used = Navigator(), []
    n.forward_speed = lambda speed, variance: used.append((n.clock, speed, variance))
    second = 1_000_000_000
    for k, more in enumerate([{}, {"quality": 0.6}, {"learned_out_of_range": True}, {}, {}]):
        n.step("imu", imu(second // 2 * (k + 1), learned_speed=5.0 + k, learned_variance=2.0, **more))
    # the first; the second is of poor quality; the third uses up its turn; the fourth comes too early
    assert used == [(second // 2, 5.0, 8.0), (second // 2 * 5, 9.0, 8.0)]


def test_a_foretold_change_applies_at_its_horizon():
    n, used = Navigator(), []
    n.forward_speed = lambda speed, variance: used.append((n.clock, speed, variance))
    for k in range(1, 25):
        n.step("imu", imu(k * 100_000_000, speed_change=-3.0, change_variance=1.5, horizon_s=1.0))
    # speeds don't fall below 0; the next is foretold when the horizon is over
    assert used == [(1_100_000_000, 0.0, 1.5), (2_100_000_000, 0.0, 1.5)]


def test_contract_of_events():
    n = Navigator()
    assert "quality" in n.step("imu", imu(1, quality=1.5))["error"]
    n.step("imu", imu(10))
    fix = {"timestamp_ns": 10, "latitude": 1.0, "longitude": 1.0, "sigma": 3.0, "east": None, "north": None, "course": None}
    assert n.step("gnss", fix | {"speed": -1.0})["error"] == "speed=-1.0 is not in [0, inf]"
    assert n.step("gnss", fix | {"speed": 1.0}) == {"timestamp_ns": 10, "accepted": True}


def test_the_handheld_filter():
    n = HANDHELD.navigator()
    out = n.step("imu", imu(1_000_000_000, accel=2.0))
    assert out["mode"] == "WAITING_FOR_GNSS" and out["speed"] == 0
    gnss = {"timestamp_ns": 1_000_000_000, "east": 0.0, "north": 0.0, "sigma": 8.0, "speed": None, "course": None}
    n.step("gnss", gnss)
    out = n.step("imu", imu(1_100_000_000, accel=2.0))
    assert out["speed"] == 0 and out["mode"] == "GNSS_AIDED"  # no course yet, so accelerations have no direction
    assert out["position_sigma"] >= 8.0 and n.p[0, 0] == pytest.approx(32.0)
    n.step("gnss", gnss | {"timestamp_ns": 1_100_000_000, "speed": 5.0, "course": 90.0})
    assert n.oriented and n.x[2] > 0 and abs(n.x[3]) < 1e-6
    n.clock = 9_000_000_000
    assert n.fix(3_000_000_000, 0.0, 0.0, 5.0) is False and n.degraded  # older than five seconds


def test_outputs_can_wait_for_the_fixes_of_their_time(spark):
    rows = [("a", "imu", k * 100_000_000, 0.0, 0.0, None, None, None) for k in range(1, 4)] + [("a", "gnss", 200_000_000, None, None, 7.0, 0.0, 2.0)]
    events = spark.createDataFrame(rows, "source_id string, type string, timestamp_ns long, accel double, yaw_rate double, east double, north double, sigma double")
    told = lambda **k: [round(r.east, 3) for r in navigation.replay(events, **k).orderBy("timestamp_ns").collect()]
    assert told() == [0, 0, 7] and told(after_fixes=True) == [0, 7, 7]


def test_folds_hold_one_state_however_rows_are_batched(spark):
    from driftline.operators.signals import folded, rate_limit

    rows = spark.range(30_000).selectExpr("id", "id % 3 as k", "cast(id as double) as t")
    got = folded(rows, ["k"], ["t"], lambda: rate_limit(10.0), "id long, t double")
    want = {k: len([1 for i in range(k, 30_000, 3)]) for k in range(3)}
    found = {r.k: r.n for r in got.groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert found == {k: math.ceil(n / 4) for k, n in want.items()}  # steps of three: every fourth is ten or more behind


def test_edge_recorders(spark):
    from driftline.operators import edge

    with pytest.raises(ValueError, match="unknown"):
        edge.Recorder("mph")
    with pytest.raises(ValueError, match="gravity"):
        edge.Recorder(without_gravity=True, gravity=(0.0, 0.0, 9.8))
    rows = [("a", 0.1, [1.0, 2.0, 9.8]), ("a", 0.1, [1.0, 2.0, 9.8]), ("a", 0.2, [1.0, None, 9.8]), ("a", 0.3, [2.0, 2.0, 9.8])]
    samples = spark.createDataFrame([(s, t, a, [0.0, 0.0, 0.5], None, k) for k, (s, t, a) in enumerate(rows)], "source_id string, time double, acceleration array<double>, angular_rate array<double>, gravity array<double>, position int")
    out = edge.normalised(samples, edge.Recorder(gravity=(0.0, 0.0, 9.8))).orderBy("position").collect()
    assert [(r.timestamp_ns, r.accel, r.error) for r in out] == [(100_000_000, 1.0, None), (None, None, "times must increase"), (None, None, "acceleration needs three finite values"), (300_000_000, 2.0, None)]


def test_an_exact_quantile_of_a_whole_column(spark):
    from driftline.operators.aggregates import spread_quantile

    values = [float(k * k % 997) for k in range(5_000)] + [3.0] * 4_000
    df = spark.createDataFrame([(v,) for v in values], "v double").unionByName(spark.createDataFrame([(None,)], "v double"))
    for p in (0.0, 0.37, 0.5, 1.0):
        assert spread_quantile(df, "v", p, small=50) == pytest.approx(np.quantile(values, p))


def test_modes_over_an_outage(spark):
    events = scenario()
    form = "source_id string, type string, timestamp_ns long, accel double, yaw_rate double, quality double, driving boolean, stationary boolean, east double, north double, sigma double, speed double, course double"
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in events.itertuples(index=False)]
    out = navigation.replay(spark.createDataFrame(rows, form), profile=navigation.Profile(output_hz=200.0)).toPandas().sort_values("timestamp_ns")
    assert out["error"].isna().all() and len(out) == 2401
    assert out["mode"].iloc[0] == "WAITING_FOR_GNSS" and out["mode"].iloc[-1] in ("GNSS_AIDED", "GNSS_REACQUIRING")
    assert {"GNSS_AIDED", "GNSS_DEGRADED", "DEAD_RECKONING", "GNSS_REACQUIRING"} <= set(out["mode"])
    assert out["speed"].iloc[-1] == pytest.approx(10, abs=0.01) and out["north"].iloc[-1] == pytest.approx(120, abs=1)


def test_what_the_filter_rejects():
    n = Navigator()
    n.inertial(10, 0.0, 0.0)
    for call in (lambda: n.inertial(10, 0.0, 0.0), lambda: n.fix(11, 0.0, 0.0, 5.0), lambda: n.fix(5, math.nan, 0.0, 5.0), lambda: n.inertial(20, math.inf, 0.0)):
        with pytest.raises(Rejected):
            call()
    assert n.fix(10, 0.0, 0.0, 36.0) is False and n.degraded
    assert n.step("other", {"timestamp_ns": 1})["error"] == "type=other is not in {imu, gnss}"
    assert "age_ns=4999999999" in Navigator(clock=5_000_000_000).step("gnss", {"timestamp_ns": 1, "latitude": 1.0, "longitude": 1.0, "sigma": 3.0, "east": None, "north": None, "speed": None, "course": None})["error"]


def latched(profile, sigmas, start=False):
    n = Navigator(profile, degraded=start)
    out = []
    for s in sigmas:
        n._judge(s)
        out.append(n.degraded)
    return out


def test_the_latch_of_each_profile():
    assert latched(HANDHELD, [5, 5, 5], True) == [True, True, False]
    assert latched(HANDHELD, [6, 16, 6, 6, 6], True) == [True, True, True, True, False]
    assert latched(navigation.EDGE, [25, 5, 25, 15], False) == [True, False, True, True]


def test_standing_still_settles_the_speed():
    n = Navigator(x=np.array([0, 0, 3.0, 0, 0, 0, 0]))
    for k in range(50):
        n.inertial(k * 10_000_000, 0.0, 0.0, stationary=True)
    assert math.hypot(*n.x[2:4]) < 0.1 and np.allclose(n.p, n.p.T) and np.linalg.eigvalsh(n.p).min() > 0


def test_rotation_check():
    assert filters.rotation_problem(np.eye(3).tolist()) is None
    assert "orthonormal" in filters.rotation_problem([[2, 0, 0], [0, 1, 0], [0, 0, 1]])
    assert "determinant" in filters.rotation_problem([[-1, 0, 0], [0, 1, 0], [0, 0, 1]])
    assert "finite" in filters.rotation_problem([[math.nan] * 3] * 3)


def test_road_xml(spark, tmp_path):
    (tmp_path / "roads.xml").write_text("""<osm><node id="1" lat="0" lon="0"/><node id="2" lat="0" lon="0.001"/><node id="3" lat="0.001" lon="0.001"/><node id="4" lat="x" lon="1"/>
<way id="10"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/><tag k="oneway" v="-1"/><tag k="tunnel" v="yes"/></way>
<way id="11"><nd ref="2"/><nd ref="3"/><tag k="highway" v="residential"/></way>
<way id="12"><nd ref="2"/><nd ref="3"/><tag k="highway" v="footway"/></way>
<way id="13"><nd ref="2"/><nd ref="3"/><tag k="highway" v="primary"/><tag k="access" v="private"/></way>
<way id="14"><nd ref="2"/><nd ref="9"/><tag k="highway" v="primary"/></way></osm>""")
    nodes, ways = maps.read_road_xml(spark, str(tmp_path / "roads.xml"))
    lat0, lon0 = maps.origin(nodes)
    assert nodes.count() == 3 and lat0 == pytest.approx(0.001 / 3)
    ways = roads.usable_ways(ways)
    from driftline.functions.scalars import to_local

    e, n = to_local(F.col("lat"), F.col("lon"), F.lit(lat0), F.lit(lon0))
    points = roads.way_points(ways.select("way", F.posexplode("refs").alias("pos", "node")), nodes.select("node", e.alias("e"), n.alias("n")))
    tag = F.col("tags")
    arcs = roads.arcs(points, ways.select("way", roads.directions(tag["oneway"], tag["junction"] == "roundabout").alias("directions"))).collect()
    assert sorted((a.way, a.start_node, a.end_node) for a in arcs) == [("10", "2", "1"), ("11", "2", "3"), ("11", "3", "2")]


def test_trajectories_and_service_answers(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<fcd><timestep time="0.0"><vehicle id="v" x="1" y="2" angle="90" speed="3"/><vehicle id="w" x="bad" y="2" angle="90" speed="3"/></timestep><timestep time="0.1"><vehicle id="v" x="1.3" y="2" angle="90" speed="3"/></timestep></fcd>')
    assert [(r.vehicle, r.t, r.x) for r in maps.read_trajectories(spark, str(tmp_path / "t.xml")).orderBy("t").collect()] == [("v", 0.0, 1.0), ("v", 0.1, 1.3)]
    answer = {"elements": [{"type": "way", "id": 5, "nodes": [1, 2], "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": 1.5, "lon": 2.5}], "tags": {"highway": "primary"}}]}
    (tmp_path / "a.json").write_text(json.dumps(answer))
    (tmp_path / "b.json").write_text(json.dumps(answer | {"remark": "timeout"}))
    assert [(r.way, r.pos, r.node, r.lat) for r in maps.read_road_service(spark, str(tmp_path / "a.json")).orderBy("pos").collect()] == [(5, 0, 1, 1.0), (5, 1, 2, 1.5)]
    with pytest.raises(Exception, match="incomplete"):
        maps.read_road_service(spark, str(tmp_path / "b.json")).collect()


def test_graph_file_goes_round(spark, tmp_path):
    arc = (0, "w", "a", "b", 0.0, 0.0, 10.0, 0.0, 10.0, 90.0, "primary", "", "", "", 0)
    arcs = spark.createDataFrame([arc], maps.ARC)
    maps.write_graph(arcs, str(tmp_path / "g"), "roads-v1", (51.5, -0.1))
    assert [tuple(r) for r in maps.read_graph(spark, str(tmp_path / "g"), "roads-v1").collect()] == [arc]
    with pytest.raises(Exception, match="unsupported"):
        maps.read_graph(spark, str(tmp_path / "g"), "other").collect()


def test_logs(spark, tmp_path):
    (tmp_path / "S-d1.csv").write_bytes(" TIME (ms) ,ACCEL X (m/s²)\n1, 2.5\nx,nan\n".encode("cp1252"))
    (tmp_path / "V-d1.csv").write_text("t\n1\n")
    (tmp_path / "S-d2.csv").write_text("t\n1\n")
    log = logs.read_log(spark, str(tmp_path / "S-d1.csv"))
    assert logs.numbers(log, {"t": "TIME", "a": "ACCEL X"}).select("t", "a").collect() == [(1.0, 2.5), (None, None)]
    with pytest.raises(ValueError):
        logs.column(log, "GPS")
    assert logs.missing_columns(log, ["file", "none"]) == ["none"]
    pairs = logs.file_pairs(logs.list_files(spark, str(tmp_path))).collect()
    assert [p.drive for p in pairs] == ["d1"] and pairs[0].vehicle.endswith("V-d1.csv")


def test_models(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, -2.0, 0.5] + 3
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    w, mean = models.ridge(df, ["a", "b", "c"], "y", 10.0)
    assert w == pytest.approx(np.linalg.solve(x.T @ x + 10 * np.eye(3), x.T @ (y - y.mean()))) and mean == pytest.approx(y.mean())
    held = np.arange(400) % 5 == 4
    model = models.train_network(x, y, held, epochs=60, batch=64, rate=0.01)
    out = models.network_score([F.col(c) for c in "abc"], model)
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    want = np.clip((np.tanh(z @ np.array(model["w1"]) + model["b1"]) @ model["w2"] + model["b2"]) * model["target_scale"] + model["target_mean"], 0, 60)
    got = df.select(out["speed"].alias("s"), "y").toPandas()
    assert got["s"].to_numpy() == pytest.approx(want) and np.sqrt(((want - np.clip(y, 0, 60)) ** 2).mean()) < 0.5
    rows = [("k", float(i), float(i * i % 7), 2.0 * i - 3.0 * (i * i % 7) + 1 + (1000 if i == 5 else 0)) for i in range(40)] + [("few", float(i), 0.0, 1.0) for i in range(20)]
    line = spark.createDataFrame(rows, "k string, a double, b double, y double")
    fits = {r.k: r for r in models.robust_fit(line, ["a", "b"], "y", ["k"]).collect()}
    assert fits["k"].coefficients == pytest.approx([2, -3, 1]) and fits["k"].n == 39 and fits["k"].r2 == pytest.approx(1)
    assert fits["few"].error and fits["few"].coefficients is None


def test_variance_head_is_calibrated_by_the_mean_ratio():
    rng = np.random.default_rng(4)
    z, held = rng.normal(size=(300, 2)), np.arange(300) % 3 == 0
    error = rng.normal(size=300) * np.exp(z[:, 0] / 2)
    noise, ratio = models.variance_head(z, error, held)
    design = np.c_[z, np.ones(300)]
    want = np.linalg.solve(design[~held].T @ design[~held] + 10 * np.eye(3), design[~held].T @ np.log(error[~held] ** 2 + 0.25))
    guess = np.exp(np.clip(design[held] @ want, -4, 8))
    assert noise == pytest.approx(want) and ratio == pytest.approx((error[held] ** 2 / np.maximum(guess, 0.25)).mean())


def test_model_files(spark):
    with pytest.raises(ValueError, match="lacks"):
        logs.load_model("{}", {"mean": 3})
    with pytest.raises(ValueError, match="finite"):
        logs.load_model('{"mean": [1, 2, Infinity]}', {"mean": 3})


def test_bins_and_sessions(spark):
    rows = spark.createDataFrame([(1, t / 1000, float(t)) for t in (0, 40, 90, 150, 900, 950)], "k long, s double, v double").select("k", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "v")
    assert sorted((r.n, r.v) for r in stream.bins(rows, ["k"], ["v"]).collect()) == [(1, 150.0), (2, 925.0), (3, 130 / 3)]
    assert sorted(r.n for r in stream.sessions(rows, ["k"], "250 milliseconds").collect()) == [2, 4]


@pytest.mark.parametrize("parts", [1, 4, 5, 27, 3000])
def test_the_parts_of_a_long_step_are_taken_together(parts, monkeypatch):
    """As one after another, and without a call for each."""
    one, two = Navigator(), Navigator()
    for navigator in (one, two):
        navigator.x = np.array([10.0, -4.0, 6.0, 2.0, 3.0, 0.01, -0.2])
        for k in range(3):
            navigator._advance(0.05, 0.4, 0.3, 0.9)
    for _ in range(parts):
        one._advance(0.04, 0.7, -0.5, 0.25)
    calls, plain = [], Navigator._advance
    monkeypatch.setattr(Navigator, "_advance", lambda *args: calls.append(1) or plain(*args))
    two._advance_by(0.04 * parts, parts, 0.7, -0.5, 0.25)
    assert len(calls) < navigation.TOGETHER
    assert np.allclose(one.x, two.x, rtol=1e-9, atol=1e-9) and np.allclose(one.p, two.p, rtol=1e-9, atol=1e-9)
