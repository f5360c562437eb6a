"""Training in tasks against training in memory."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from driftline.operators import models
from pyspark.sql import functions as F


def test_a_network_trained_in_tasks_is_the_one_trained_in_memory(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = 10 + x @ [2.0, -1.0, 0.5] + rng.normal(0, 0.3, 300)
    held = np.arange(300) % 5 == 4
    rows = pd.DataFrame({"id": np.arange(300), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "batch": "x", "held": held})
    df = spark.createDataFrame(rows)
    odd = spark.createDataFrame([(900, None, 1.0, 1.0, 1.0, "x", False), (901, 1.0, 1.0, 1.0, float("nan"), "x", False), (902, 1.0, 1.0, 1.0, 1.0, "x", None)], df.schema)
    got = models.train_in_tasks(df.union(odd), ["a", "b", "c"], "y", F.col("held"), "id", epochs=3, batch=64, rate=0.01)
    place = df.select(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(3)), F.lit(4)).alias("k")).toPandas()["k"].to_numpy()
    want = models.train_network(x, y, held, epochs=3, rate=0.01, place=place)
    for part, value in want.items():
        assert np.array(got[part]) == pytest.approx(np.array(value), abs=1e-6), part


def test_training_keeps_jobs_bounded_and_needs_rows_to_fit(spark, monkeypatch):
    df = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("y"))
    seen = []
    monkeypatch.setattr(models, "descend", lambda gradient, loss, width, steps, *more: seen.append((steps, len(gradient(start, 0)), loss(start), loss(start))) or start)
    start = [np.zeros((1, 24)), np.zeros(24), np.zeros(24), np.zeros(1)]
    model = models.train_in_tasks(df, ["a"], "y", F.lit(False), "id", batch=10, steps=6)
    assert seen == [(6, 4, 0, -1)] and model["variance_calibration"] == 1.0
    with pytest.raises(ValueError):
        models.train_in_tasks(df, ["a"], "y", F.lit(True), "id")
    with pytest.raises(ValueError):
        models.train_in_tasks(df.limit(0), ["a"], "y", F.lit(False), "id")


def test_steps_read_no_files_and_nothing_stays_kept(spark, monkeypatch):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("y"))
    start = [np.full((1, 24), 0.1), np.zeros(24), np.full(24, 0.1), np.zeros(1)]
    written, write = [], models.materialise
    monkeypatch.setattr(models, "materialise", lambda *args, **more: written.append(write(*args, **more)) or written[-1])

    def descend(gradient, loss, width, steps, *more):
        models.release(*written)
        assert steps == 3 and all(len(gradient(start, k)) == 4 for k in range(steps)) and loss(start) > 0
        return start

    monkeypatch.setattr(models, "descend", descend)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    models.train_in_tasks(df, ["a"], "y", F.col("id") % 5 == 4, "id", batch=60)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_held_rows_are_dealt_to_tasks_too(spark, monkeypatch):
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("y"))
    tasks, write = [], models.materialise

    def counted(*args, **more):
        table = write(*args, **more)
        tasks.append(table.where("batch = -1").select(F.input_file_name()).distinct().count())
        return table

    monkeypatch.setattr(models, "materialise", counted)
    monkeypatch.setattr(models, "PART", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small partitions become one
    try:
        models.train_in_tasks(df, ["a"], "y", F.col("id") % 2 == 0, "id", epochs=1, batch=20)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks[0] > 1


def test_the_features_of_the_network_are_made_once(spark):
    from driftline.plans import registry

    from .conftest import SF

    out = registry.queries()["mdl5_network_training"](spark, SF)
    assert "Window" not in out._jdf.queryExecution().toString() and out.count() == 310
