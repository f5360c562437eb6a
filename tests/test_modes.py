"""Modes in columns against the filter itself, graph files, arrays, and functions in SQL text."""

from __future__ import annotations

import numpy as np
import pytest
from driftline.functions import tables
from driftline.operators import modes, navigation
from driftline.plans.motion import MODEL
from driftline.sources import arrays, logs, maps
from pyspark.sql import functions as F


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_modes_in_columns_are_those_of_the_filter(spark, seed):
    rng = np.random.default_rng(seed)
    rows, ns = [], 1
    for k in range(900):
        ns += 50_000_000
        rows.append(("a", "imu", ns, 0.0, 0.0, None, None, None))
        silent = (k // 90) % 3 == 2
        if not silent and rng.random() < 0.12:
            far = 500.0 if rng.random() < 0.15 else 0.0
            rows.append(("a", "gnss", ns, None, None, far, 0.0, float(rng.choice([5.0, 11.0, 15.0, 22.0, 30.0, 50.0]))))
    events = spark.createDataFrame(rows, "source_id string, type string, timestamp_ns long, accel double, yaw_rate double, east double, north double, sigma double")
    profile = navigation.Profile(output_hz=1000.0, tell_fixes=True)
    said = navigation.replay(events, profile=profile).collect()
    verdict = {r.timestamp_ns: r.accepted for r in said if r.accepted is not None}
    want = {r.timestamp_ns: r.mode for r in said if r.mode is not None}
    judged = spark.createDataFrame([(r[0], r[1], r[2], r[7], verdict.get(r[2]) if r[1] == "gnss" else None) for r in rows], "source_id string, type string, timestamp_ns long, sigma double, accepted boolean")
    got = {r.timestamp_ns: r.mode for r in modes.modes(judged, ["source_id"], profile).collect()}
    assert got == want and set(want.values()) >= {"WAITING_FOR_GNSS", "DEAD_RECKONING", "GNSS_REACQUIRING", "GNSS_DEGRADED"}


def test_graphs_out_of_range_are_errors(spark, tmp_path):
    good = (0, "w", "a", "b", 0.0, 0.0, 10.0, 0.0, 10.0, 90.0, "primary", "", "", "", 0)
    write = lambda name, arc, at=(51.5, -0.1): maps.write_graph(spark.createDataFrame([good, arc], maps.ARC), str(tmp_path / name), "roads-v1", at, attribution="me")
    read = lambda name, **k: maps.read_graph(spark, str(tmp_path / name), "roads-v1", **k)
    write("good", good)
    assert read("good").count() == 2
    assert [tuple(r)[1:] for r in maps.graph_origins(spark, str(tmp_path / "good"), "roads-v1").collect()] == [(51.5, -0.1, 60.0, "me")]
    with pytest.raises(Exception, match="1 to 1 arcs, found 2"):
        read("good", most=1).collect()
    write("far", (*good[:4], 0.0, 300_000.0, *good[6:]))
    with pytest.raises(Exception, match="start_n_m lies within 200000.0 m, found 300000.0"):
        read("far").collect()
    write("flat", (*good[:8], 0.0, *good[9:]))
    with pytest.raises(Exception, match="length_m is above 0.*found 0.0"):
        read("flat").collect()
    write("origin", good, (95.0, 0.0))
    with pytest.raises(Exception, match="origin_latitude_deg lies in .*found 95.0"):
        read("origin").select("way_id").collect()


def test_files_of_arrays(spark, tmp_path):
    np.savez(tmp_path / "a.npz", X=np.arange(24.0).reshape(4, 3, 2), y=np.array([1.0, 2.0, 3.0, np.nan]), drive=np.array([1, 1, 2, 2]), name=np.array(["p", "q", "r", "s"]))
    np.savez_compressed(tmp_path / "b.npz", X=np.ones((25_000, 3, 2)), y=np.ones(25_000), drive=np.full(25_000, 3), name=np.full(25_000, "b"))
    spark.dataSource.register(arrays.ArrayFiles)
    df = spark.read.format("arrays").option("columns", "X,y,drive").load(str(tmp_path))
    assert [f.simpleString() for f in df.schema] == ["file:string", "row:bigint", "X:array<array<double>>", "y:double", "drive:bigint"]
    assert df.count() == 25_004 and df.rdd.getNumPartitions() == 2
    row = df.where("drive = 2 and row = 2").first()
    assert row.X == [[12.0, 13.0], [14.0, 15.0], [16.0, 17.0]] and row.y == 3.0
    assert spark.read.format("arrays").load(str(tmp_path / "a.npz")).select("name").collect()[1].name == "q"
    with pytest.raises(Exception, match="lacks"):
        spark.read.format("arrays").option("columns", "X,z").load(str(tmp_path)).count()
    with pytest.raises(Exception, match="not finite"):
        spark.read.format("arrays").option("columns", "y").option("finite", "true").load(str(tmp_path)).count()
    np.savez(tmp_path / "c.npz", X=np.ones((2, 3, 2)), y=np.ones(3), drive=np.ones(2, int))
    with pytest.raises(Exception, match="differ in rows"):
        spark.read.format("arrays").option("columns", "X,y,drive").load(str(tmp_path)).count()


def test_functions_in_sql_text(spark):
    tables.register(spark, MODEL)
    assert [tuple(r) for r in spark.sql("SELECT * FROM time_grid(1.0D, 1.31D, 10.0D)").collect()] == [(0, 1.0), (1, 1.1), (2, 1.2), (3, pytest.approx(1.3))]
    assert spark.sql("SELECT * FROM time_grid(1.0D, NULL, 10.0D)").count() == 0
    legs = spark.sql("SELECT r.* FROM VALUES (array(0D, 0D, 0D, 10D), array(0D, 5D, 5D, 5D)) AS t(e, n), LATERAL route_legs(t.e, t.n) r ORDER BY leg").collect()
    assert [(r.leg, r.length, r.bearing, r.so_far, r.say) for r in legs] == [(1, 5.0, 0.0, 5.0, "Start"), (2, 10.0, 90.0, 15.0, "Turn right")]
    from driftline.operators import models

    features = [0.1 + 0.01 * k for k in range(20)]
    want = spark.range(1).select(models.network_score([F.lit(x) for x in features], MODEL)["speed"].alias("s")).first().s
    text = ", ".join(f"{x}D" for x in features)
    assert spark.sql(f"SELECT network_speed(array({text})) AS s").first().s == pytest.approx(want)


def test_columns_that_files_lack(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿time, "x" ,y\n1,2,3\n')
    (tmp_path / "b.csv").write_text("time\n" + "1\n" * 50)
    (tmp_path / "c.csv").write_text("time,x,y,z\n")
    got = {r.file.rsplit("/", 1)[1]: r.missing for r in logs.missing_by_file(spark, str(tmp_path), ["time", "x", "z", "y"]).collect()}
    assert got == {"a.csv": ["z"], "b.csv": ["x", "z", "y"]}


def test_exact_quantiles_of_keys_of_any_size(spark, monkeypatch):
    """Large keys close in on the row: distinct values, many equal ones, far outliers, small and null keys."""
    from driftline.operators import aggregates

    monkeypatch.setattr(aggregates, "TOGETHER", 100)
    rng = np.random.default_rng(4)
    values = {"distinct": rng.normal(size=5_000), "equal": np.repeat([1.0, 2.0, 2.5], [900, 1_400, 701]), "far": np.concatenate([rng.random(3_000), [1e300, -1e300]]), "one": np.full(2_000, 7.0), "few": rng.random(17), None: rng.random(3_001)}
    rows = [(k, float(v)) for k, own in values.items() for v in own] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.k: [r[name] for name in shares] for r in aggregates.keyed_quantiles(df, "v", ["k"], shares).collect()}
    want = {k: pytest.approx([float(np.quantile(own, p)) for p in shares.values()], rel=1e-12) for k, own in values.items()}
    assert got == want | {"none": [None] * 5}
