"""Folds over signals against stated cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from driftline.functions.scalars import GRAVITY, rotation_zyx
from driftline.operators import signals as G
from driftline.plans import signals

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("yaw", [0.0, 0.8, -2.2])
@pytest.mark.parametrize("pitch", [0.0, 0.7])
def test_the_mount_is_recovered(yaw, pitch):
    mount = np.array(rotation_zyx(0.0, pitch, yaw))
    c = G.MountCalibration()
    for second in range(13):
        for k in range(100):
            c.inertial((second * 100 + k) * 10_000_000 + 1, mount.T @ [1.0, 0.0, 0.0], mount.T @ [0.0, 0.0, GRAVITY])
        c.gnss((second * 100 + 99) * 10_000_000 + 1, 5.0 + second, 30.0, 4.0)
    assert c.rotation == pytest.approx(mount, abs=1e-6)
    assert c.project(mount.T @ [2.0, 0.0, 0.0], mount.T @ [0.0, 0.0, 0.2]) == pytest.approx((2.0, 0.2))
    for k in range(25):  # the device is turned over
        c.inertial(20_000_000_000 + k * 10_000_000, np.zeros(3), mount.T @ [GRAVITY, 0.0, 0.0])
    assert c.rotation is None


def test_constant_speed_shows_nothing():
    c = G.MountCalibration()
    for second in range(20):
        for k in range(100):
            c.inertial((second * 100 + k) * 10_000_000 + 1, np.zeros(3), np.array([0.0, 0.0, GRAVITY]))
        c.gnss((second * 100 + 99) * 10_000_000 + 1, 10.0, 30.0, 4.0)
    assert c.rotation is None


def test_a_moved_mount_is_noticed_and_learned_again():
    y = G.YawAlignment()
    for _ in range(10):
        y.add(0.3)
    assert y.offset == pytest.approx(0.3) and y.confidence() == pytest.approx(10 / 12)
    y.add(1.3)
    assert y.moved and y.offset == pytest.approx(0.3)
    for _ in range(12):
        y.add(1.3)
    assert not y.moved and y.offset == pytest.approx(1.3)


def test_low_pass_settles_and_starts_anew():
    step = G.low_pass()
    row = lambda t, v, q=1.0: step({"id": 0, "t": t, "value": v, "quality": q})["smooth"]
    assert row(0.0, 50.0) == 12.0
    assert row(0.01, 0.0) == pytest.approx(12 * math.exp(-2 * math.pi * 4 * 0.01))
    assert row(1.0, 3.0) == 3.0
    assert row(1.1, 0.0, 0.1) == pytest.approx(3 * math.exp(-2 * math.pi * 1.5 * 0.1))


def test_motion_classes():
    m = G.MotionClass()
    row = lambda t, **k: m({"id": 0, "t": t, "accel": 0.1, "gyro": 0.02, "vertical": 0.02, "fix_age": 1.0, "accuracy": 5.0, "speed": 0.0} | k)
    still = [row(k * 0.1) for k in range(30)]
    assert still[5]["event"] == "UNCERTAIN" and still[-1]["event"] == "STATIONARY" and 0 < still[-1]["bias"] <= 0.02
    assert row(3.1, accel=6.0)["event"] == "IMPACT"
    drive = [row(10 + k * 0.1, speed=9.0, accel=0.3) for k in range(60)]
    assert drive[-1]["event"] == "MOVING" and drive[-1]["driving"]
    assert row(16.1, speed=9.0, accel=0.3, vertical=0.4)["event"] == "TURNING"
    assert row(16.2, speed=None, fix_age=None, accel=0.1)["driving"]


def test_guidance_never_goes_back():
    g = G.Guidance([(0, 0, 100, 0), (100, 0, 100, 100)])
    out = [g({"id": k, "e": e, "n": n}) for k, (e, n) in enumerate([(10, 1), (50, 2), (20, 0), (100, 40), (500, 500)])]
    assert [o["progress"] for o in out] == [10, 50, 50, 140, 140] and out[0]["deviation"] == 1 and out[3]["remaining"] == 60


@pytest.mark.parametrize("name", list(signals.QUERIES))
def test_queries_run(spark, name):
    assert signals.QUERIES[name](spark, SF).count() > 0


def test_vectors_are_handled_without_table_functions(monkeypatch):
    """The calibration's sums, sizes and products equal numpy's, which cost more than the sums themselves."""
    a, b = np.array([0.3, -1.7, 2.9]), np.array([5.1, 0.2, -0.4])
    assert (G._cross(a, b) == np.cross(a, b)).all() and (G._mean([a, b, a]) == np.mean([a, b, a], axis=0)).all()
    assert G._size(a) == pytest.approx(np.linalg.norm(a), rel=1e-15)
    monkeypatch.setattr(np, "cross", None)
    fold = G.CalibrationFold()
    told = [fold({"id": k, "ns": k * 100_000_000, "ax": 0.0, "ay": 1.0, "speed": 10.0 + k / 10 if k % 10 == 0 else None}) for k in range(200)]
    assert told[-1]["ready"] and told[-1]["forward"] == pytest.approx(1.0)
