"""Streams with typed state against the batch: restart from a checkpoint, silent sources, completed bins; and the folds."""

from __future__ import annotations

import contextlib
import json
import math
import os
import time

import pandas as pd
import pytest
from driftline.operators import folds, navigation, service
from driftline.operators import timeseries as T
from driftline.operators.signals import folded, rate_limit
from driftline.sources import logs
from driftline.streaming import navigation as stream
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F


def lines_of(source, n=300, start=0):
    out = []
    for k in range(start, start + n):
        out.append(json.dumps({"type": "imu", "source_id": source, "timestamp_ns": 1 + k * 10_000_000, "acceleration": [0.1, 0, 0], "angular_rate": [0, 0, 0.01]}))
        if k % 100 == 50:
            out.append(json.dumps({"type": "gnss", "source_id": source, "timestamp_ns": 1 + k * 10_000_000, "latitude_deg": 51.5 + k * 1e-7, "longitude_deg": -0.1, "horizontal_sigma_m": 4.0, "speed_mps": 1.0, "heading_deg_north_clockwise": 10.0}))
    return out


def put(folder, name, lines, age):
    (folder / name).write_text("\n".join(lines) + "\n")
    os.utime(folder / name, (1_000_000_000 + age, 1_000_000_000 + age))  # files come oldest first


def told(df):
    return df.drop("delay_p95_ms").toPandas().sort_values(["source_id", "timestamp_ns", "accepted", "error"], na_position="first").reset_index(drop=True).astype(object).where(lambda x: x.notna(), None)


def run(spark, folder, checkpoint, name, silent=None, until=None):
    """The records of a run over the files that are there and not yet done; with timers it goes on until told to stop."""
    lines = spark.readStream.option("maxFilesPerTrigger", 1).option("latestFirst", False).text(str(folder))
    events, _ = stream.filter_events(lines)
    writer = stream.navigate(events, hz=100.0, silent=silent).writeStream.format("parquet").option("path", str(folder) + name).option("checkpointLocation", str(checkpoint)).outputMode("append")
    if silent is None:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination(180)
    else:
        query = writer.trigger(processingTime="500 milliseconds").start()
        for _ in range(60):
            time.sleep(1)
            with contextlib.suppress(AnalysisException):  # nothing is committed yet
                if spark.read.parquet(str(folder) + name).where(until).count():
                    break
        query.stop()
    assert query.exception() is None
    return spark.read.parquet(str(folder) + name)


def test_a_stream_goes_on_after_a_restart_as_the_batch_does(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    a, b = lines_of("s"), lines_of("r", 120)
    put(folder, "a.jsonl", [*a[:200], "", "not json", '{"type":"imu","quality":NaN}', *b[:70]], 0)
    run(spark, folder, tmp_path / "state", "out", silent=None)
    put(folder, "b.jsonl", [*a[200:], *b[70:]], 10)
    got = told(run(spark, folder, tmp_path / "state", "out", silent=None))
    events, errors = stream.filter_events(spark.read.text(str(folder)))
    assert errors.count() == 2
    want = told(service.serve(events, hz=100.0))
    assert len(got) == len(want) > 40
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    last = want[(want["source_id"] == "s") & want["mode"].notna()].iloc[-1]
    assert last["samples"] > 256 and last["input_hz"] == pytest.approx(100) and last["jitter_ms"] == pytest.approx(0, abs=1e-6) and last["gaps"] == 0
    assert last["last_fix_accepted"] is True and 0 <= last["fix_age_s"] < 1 and last["latitude"] == pytest.approx(51.5, abs=1e-3)


def test_late_events_are_answered_with_an_error(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.jsonl", lines_of("s", 30, 10), 0)
    put(folder, "b.jsonl", lines_of("s", 5, 0), 10)
    got = run(spark, folder, tmp_path / "state", "out", silent=None)
    assert got.where("error is not null").count() == 5
    assert got.where("error like 'timestamp_ns=1 is not in (390000001, inf]'").count() == 1


def test_a_silent_source_is_told_and_forgotten(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.jsonl", lines_of("quiet", 30), 0)
    got = run(spark, folder, tmp_path / "state", "out", 1_000, "mode = 'SILENT'")
    assert [(r.source_id, r.timestamp_ns) for r in got.where("mode = 'SILENT'").collect()] == [("quiet", 290_000_001)]
    put(folder, "b.jsonl", lines_of("quiet", 3, 5), 10)  # begins anew, though its times are old
    got = run(spark, folder, tmp_path / "state", "out", 60_000, "timestamp_ns = 50000001")
    assert got.where("error is not null").count() == 0 and got.where("samples = 1").count() == 2


def test_bins_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    """Rows come shuffled within each file; there are gaps, skipped bins and a late row."""
    import random

    rng = random.Random(3)
    rows, ns = [], 0
    for k in range(900):
        ns += rng.choice([20, 30, 40]) * 1_000_000
        if k in (300, 600):
            ns += 400_000_000
        if k == 450:
            ns += 180_000_000
        rows.append({"k": "a" if k % 2 else "b", "ns": ns, "v": rng.random(), "w": rng.random() * 5})
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(3):
        own = rows[part * 300 : part * 300 + 300]
        rng.shuffle(own)
        put(folder, f"{part}.jsonl", [json.dumps(r) for r in own] + ([json.dumps({"k": "a", "ns": 5, "v": 0.0, "w": 0.0})] if part == 2 else []), part)
    form = "k string, ns long, v double, w double"
    query = stream.stream_bins(spark.readStream.schema(form).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(folder)), "k", "ns", ["v", "w"], size=5).writeStream.format("memory").queryName("bins").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    names = ["k", "start", *[f"{v}_{s}" for s in stream.STATISTICS for v in ("v", "w")]]
    flat = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())
    want = flat(T.completed_bins(spark.createDataFrame([tuple(r.values()) for r in rows], form), "ns", ["v", "w"], ["k"], 100_000_000, 250_000_000, 5))
    assert flat(spark.table("bins").where("error is null")) == want and len(want) > 50
    assert [r.error.split(" ")[0] for r in spark.table("bins").where("error is not null").collect()] == ["ns=5"]


def test_lines_are_numbered_in_each_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"row {k}\n" if k % 3 else "\n" for k in range(1, 2001)))
    (tmp_path / "b.txt").write_text("one\ntwo")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = logs.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted((r.line, r.value) for r in got if r.file.endswith("a.txt")) == [(k, f"row {k}" if k % 3 else "") for k in range(1, 2001)]
    assert sorted((r.line, r.value) for r in got if r.file.endswith("b.txt")) == [(1, "one"), (2, "two")]


def test_records_name_the_line_of_a_bad_event(spark, tmp_path):
    lines = lines_of("s", 20)
    (tmp_path / "x.jsonl").write_text("\n".join([*lines[:5], "", lines[2], "oops", *lines[5:]]))
    events, errors = stream.filter_events(logs.numbered_lines(spark, str(tmp_path)))
    assert [(r.line, r.text) for r in errors.select("line", "text").collect()] == [(8, "oops")]
    # of two samples of one time the second is late, whichever line it stands in
    assert [r.line for r in service.serve(events, hz=100.0).where("error is not null").collect()] in ([7], [3])


# --- folds ------------------------------------------------------------------------------------------------------------
def test_work_is_packed_into_as_many_tasks_as_cores(spark):
    rows = spark.range(40_000).select((F.col("id") % 37).alias("k"), F.col("id").alias("t"))
    rows = rows.unionByName(spark.range(20_000).select(F.lit(99).cast("long").alias("k"), F.col("id").alias("t")))
    dealt = folds.dealt_by_work(rows, ["k"])
    sizes = {r["p"]: r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    cores = spark.sparkContext.defaultParallelism
    assert dealt.rdd.getNumPartitions() == cores == len(sizes)
    assert max(sizes.values()) <= 20_000 + 2 * 40_000 / 37 and min(sizes.values()) > 5_000
    assert dealt.select("k", F.spark_partition_id()).distinct().count() == 38


def test_no_rows_and_null_keys(spark):
    rows = spark.createDataFrame([(None, 0.0), (None, 11.0), ("a", 0.0), ("a", 5.0)], "k string, t double").withColumn("id", F.lit(1).cast("long"))
    make = lambda df: folded(df, ["k"], ["t"], lambda: rate_limit(10.0), "id long, t double")
    assert sorted((r.k or "", r.t) for r in make(rows).collect()) == [("", 0.0), ("", 11.0), ("a", 0.0)]
    assert make(rows.where("false")).count() == 0


def test_a_saved_state_goes_on_as_the_filter_would(spark):
    for profile in (navigation.EDGE, navigation.HANDHELD):
        one = profile.navigator()
        events = [("imu", {"timestamp_ns": k * 50_000_000 + 1, "accel": math.sin(k), "yaw_rate": 0.1, "quality": 0.9, "driving": True, "stationary": False, "speed_change": 0.5, "change_variance": 1.0, "horizon_s": 1.0}) for k in range(60)]
        fixes = [("gnss", {"timestamp_ns": k * 50_000_000 + 1, "east": k * 0.3, "north": 1.0, "sigma": 4.0, "speed": 2.0, "course": 80.0}) for k in range(0, 60, 15)]
        events = sorted(events + fixes, key=lambda e: (e[1]["timestamp_ns"], e[0] == "gnss"))
        for k, event in enumerate(events):
            one.step(*event)
            if k == 40:
                two = profile.navigator().restored(one.saved())
            if k > 40:
                two.step(*event)
        assert one.saved() == two.saved()
