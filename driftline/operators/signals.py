"""Ordered folds over the signals of one recorder: smoothing, alignment of the mount, motion classes, guidance.

Each is a small state machine fed by ``folded``, which hands it the rows of one recording in order, batch by batch. The
only shuffle is by recording.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .folds import carried, in_order
from .navigation import clean, wrapped


def folded(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable[[dict], dict | None]], columns: str) -> DataFrame:
    """What a fresh state machine for each key makes of its ordered rows: a row, or none, for each. ``columns`` names
    what it returns, after the keys."""

    def step(machine: Callable[[dict], dict | None], rows: list[dict], done: bool) -> list[dict]:
        return [made for row in rows if (made := machine(clean(row))) is not None]

    return carried(df, keys, in_order(order), start, step, columns)


def low_pass(limit: float = 12.0, poor: float = 0.4, slow: float = 1.5, fast: float = 4.0, reset: float = 0.25) -> Callable[[dict], dict]:
    """Exponential smoothing of bounded ``value`` over ``t``; a poor ``quality`` lowers the cut-off, a gap starts anew."""
    last: list[float | None] = [None, None]

    def step(row: dict) -> dict:
        value, (t0, smooth) = min(max(row["value"], -limit), limit), last
        dt = row["t"] - t0 if t0 is not None else math.inf
        if smooth is None or dt > reset:
            smooth = value
        else:
            smooth += (1 - math.exp(-2 * math.pi * (slow if row["quality"] < poor else fast) * max(dt, 0.0))) * (value - smooth)
        last[:] = row["t"], smooth
        return {"id": row["id"], "smooth": smooth}

    return step


def rate_limit(period: float) -> Callable[[dict], dict | None]:
    """Rows at least ``period`` after the last one let through."""
    last = [-math.inf]

    def step(row: dict) -> dict | None:
        if row["t"] - last[0] < period:
            return None
        last[0] = row["t"]
        return {"id": row["id"], "t": row["t"]}

    return step


class YawAlignment:
    """The constant angle between a device's azimuth and the vehicle's course, from their differences.

    A difference far from the agreed angle, after enough that agreed, means that the mount has moved; a new angle is
    agreed on when the latest differences lie close together.
    """

    RING, SETTLED, AGREED, MOVED, CLOSE = 20, 8, 12, math.radians(32), math.radians(12)

    def __init__(self) -> None:
        self.ring: deque[float] = deque(maxlen=self.RING)
        self.offset: float | None = None
        self.moved = False

    def add(self, difference: float) -> None:
        difference = wrapped(difference)
        if self.offset is not None and not self.moved and len(self.ring) >= self.SETTLED and abs(wrapped(difference - self.offset)) > self.MOVED:
            self.moved = True
            self.ring.clear()
        self.ring.append(difference)
        mean = math.atan2(sum(map(math.sin, self.ring)), sum(map(math.cos, self.ring)))
        if self.moved and len(self.ring) >= self.AGREED and max(abs(wrapped(d - mean)) for d in self.ring) < self.CLOSE:
            self.moved = False
        if not self.moved:
            self.offset = mean

    def confidence(self) -> float:
        n = len(self.ring)
        if self.offset is None or n < 3:
            return 0.0
        return min(1.0, math.hypot(sum(map(math.sin, self.ring)) / n, sum(map(math.cos, self.ring)) / n)) * min(1.0, n / self.AGREED)

    def __call__(self, row: dict) -> dict:
        self.add(row["course"] - row["azimuth"])
        return {"id": row["id"], "offset": self.offset, "confidence": self.confidence(), "moved": self.moved}


class MountCalibration:
    """The rotation from a device's axes to the vehicle's, from gravity and from accelerations on straight stretches.

    Between two good fixes of nearly the same course the speed's change gives the sign of the mean acceleration across
    gravity; its directions must agree before the rotation is used. A lasting turn of gravity starts it anew.
    """

    def __init__(self) -> None:
        self.samples: deque[tuple[int, np.ndarray, np.ndarray]] = deque()
        self.directions: deque[np.ndarray] = deque(maxlen=30)
        self.fix: tuple[int, float, float] | None = None
        self.locked: np.ndarray | None = None
        self.off_axis = 0
        self.rotation: np.ndarray | None = None
        self.confidence = 0.0

    def inertial(self, ns: int, linear: np.ndarray, gravity: np.ndarray) -> None:
        size = _size(gravity)
        if not (all(map(math.isfinite, linear.tolist())) and 7 <= size <= 12) or self.samples and ns <= self.samples[-1][0]:
            return
        tilted = self.locked is not None and float(self.locked @ gravity) / size < math.cos(math.radians(15))
        self.off_axis = self.off_axis + 1 if tilted else 0
        if self.off_axis >= 20:
            self.__init__()
        self.samples.append((ns, linear, gravity))
        while ns - self.samples[0][0] > 3_000_000_000:
            self.samples.popleft()

    def gnss(self, ns: int, speed: float, course: float, accuracy: float) -> None:
        if not all(map(math.isfinite, (speed, course, accuracy))) or not 0.01 <= accuracy <= 15 or speed < 2:
            self.fix = None
            return
        if self.fix is not None and ns <= self.fix[0]:
            return
        before, self.fix = self.fix, (ns, speed, course)
        if before is None:
            return
        dt = (ns - before[0]) / 1e9
        pull = (speed - before[1]) / dt
        straight = abs((course - before[2] + 540) % 360 - 180) <= 5 and 0.5 <= dt <= 2 and 0.3 <= abs(pull) <= 4
        own = [s for s in self.samples if before[0] <= s[0] <= ns] if straight else []
        if len(own) < 4 or own[-1][0] - own[0][0] < 0.6 * dt * 1e9:
            return
        up = _unit(_mean([s[2] for s in own]))
        mean = _mean([s[1] for s in own])
        level = mean - (mean @ up) * up
        if 0.2 <= _size(level) <= 5:
            self.directions.append(_unit(level) * math.copysign(1, pull))
            self._solve(up)

    def _solve(self, up: np.ndarray) -> None:
        mean = _mean(list(self.directions))
        coherence = min(1.0, _size(mean))
        self.confidence = coherence * min(1.0, len(self.directions) / 10)
        forward = _unit(mean - (mean @ up) * up)
        left = _unit(_cross(up, forward))
        above = _unit(_cross(forward, left))
        ready = self.confidence >= 0.75 and coherence >= 0.93
        self.rotation = np.stack([forward, left, above]) if ready else None
        self.locked = above if ready else self.locked

    def project(self, linear: np.ndarray, rate: np.ndarray) -> tuple[float, float] | None:
        """Forward acceleration and yaw rate of a sample, once the rotation is known."""
        return None if self.rotation is None else (float(self.rotation[0] @ linear), float(self.rotation[2] @ rate))


class CalibrationFold:
    """``MountCalibration`` over rows ns, ax, ay (level acceleration of the device, gravity along its third axis) and,
    where there is a fix, its speed: whether the rotation is known, how sure, and the forward acceleration."""

    GRAVITY, STILL = np.array([0.0, 0.0, 9.81]), np.zeros(3)

    def __init__(self) -> None:
        self.calibration = MountCalibration()

    def __call__(self, row: dict) -> dict:
        linear, gravity = np.array([row["ax"], row["ay"], 0.0]), self.GRAVITY
        self.calibration.inertial(int(row["ns"]), linear, gravity)
        if row["speed"] is not None:
            self.calibration.gnss(int(row["ns"]), row["speed"], 90.0, 5.0)
        told = self.calibration.project(linear, self.STILL)
        return {"id": row["id"], "ready": told is not None, "confidence": self.calibration.confidence, "forward": told[0] if told else None}


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(_size(v), 1e-9)


def _mean(vectors: list[np.ndarray]) -> np.ndarray:
    return np.add.reduce(vectors) / len(vectors)


def _size(v: np.ndarray) -> float:
    return math.sqrt(float(v @ v))


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cross product of two vectors; numpy's own is made for tables of them."""
    (a0, a1, a2), (b0, b1, b2) = a.tolist(), b.tolist()
    return np.array([a1 * b2 - a2 * b1, a2 * b0 - a0 * b2, a0 * b1 - a1 * b0])


class MotionClass:
    """What a recorder is doing, how far its samples can be trusted, and its gyroscope's bias from times at rest.

    Rows have t, accel (norm of the linear acceleration), gyro (norm of the rate), vertical (rate about gravity) and the
    latest fix: fix_age, accuracy, speed. Impacts come before rest, rest before vibration, vibration before turns.
    """

    def __init__(self) -> None:
        self.before: tuple[float, float] | None = None
        self.norms: deque[float] = deque(maxlen=50)
        self.still, self.moving_known, self.bias, self.n_bias = 0.0, False, 0.0, 0

    def __call__(self, row: dict) -> dict:
        accel, gyro = row["accel"], abs(row["gyro"] - self.bias)
        dt = row["t"] - self.before[0] if self.before else 0.0
        jerk = abs(accel - self.before[1]) / dt if self.before and 1e-4 < dt < 0.25 else 0.0
        self.before = row["t"], accel
        self.norms.append(accel)
        shaking = float(np.std(self.norms)) if len(self.norms) >= 10 else 0.0
        fresh = row["fix_age"] is not None and row["fix_age"] <= 2 and row["accuracy"] is not None and row["accuracy"] <= 30 and row["speed"] is not None
        quiet = row["speed"] < 0.8 and gyro < 0.10 and accel < 0.55 if fresh else not self.moving_known and gyro < 0.045 and accel < 0.22
        self.still = (self.still + dt if 0.001 <= dt <= 0.2 else self.still) if quiet else 0.0
        if self.still >= 2 and gyro < 0.10 and accel < 0.55:
            self.n_bias += 1
            self.bias += min(1 / self.n_bias, 0.02) * (row["gyro"] - self.bias)
        if fresh:
            self.moving_known = row["speed"] > 2
        moving = self.moving_known and (fresh or self.still < 2)
        impact, vibrating = accel > 5 or jerk > 55, shaking > 0.85
        event = next(name for name, holds in (
            ("IMPACT", impact), ("STATIONARY", self.still >= 2), ("VIBRATION", vibrating), ("TURNING", abs(row["vertical"] - self.bias) > 0.14), ("MOVING", moving), ("UNCERTAIN", True),
        ) if holds)
        quality = 0.15 if impact else 0.35 if vibrating else 0.45 if dt > 0.1 else 0.75
        return {"id": row["id"], "event": event, "quality": quality, "stationary": self.still >= 2, "driving": moving and not impact and not vibrating, "bias": self.bias}


class Guidance:
    """Progress along a route of legs (start and end east and north): the nearest place that isn't more than 15 m behind."""

    def __init__(self, legs: list[tuple[float, float, float, float]]) -> None:
        self.start, self.end = np.array(legs)[:, :2], np.array(legs)[:, 2:]
        self.length = np.hypot(*(self.end - self.start).T)
        self.before = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.progress = 0.0

    def __call__(self, row: dict) -> dict:
        here, way = np.array([row["e"], row["n"]]), self.end - self.start
        f = np.clip(((here - self.start) * way).sum(1) / np.maximum(self.length**2, 1e-12), 0, 1)
        off = np.hypot(*(here - self.start - f[:, None] * way).T)
        along = self.before + f * self.length
        allowed = np.flatnonzero(along >= self.progress - 15)
        best = allowed[off[allowed].argmin()] if len(allowed) else None
        deviation = float(off[best]) if best is not None else math.inf
        if best is not None and deviation <= 60:
            self.progress = max(self.progress, float(along[best]))
        return {"id": row["id"], "progress": self.progress, "remaining": max(0.0, float(self.length.sum()) - self.progress), "deviation": deviation}


def synthetic_recorder(rows: pd.DataFrame, hz: float, seed: int) -> pd.DataFrame:
    """Twelve channels of a mounted recorder along a trajectory (t, angle clockwise from North, speed): resampled, turned
    into a fixed random mount, with biases, random walks, noise and vibration. Labels (speed) stay undisturbed."""
    from ..functions.scalars import GRAVITY, rotation_zyx

    rng, dt = np.random.default_rng(seed), 1 / hz
    rows = rows.sort_values("t")
    rows = rows[np.concatenate([[True], np.diff(rows["t"]) > 1e-6])]
    t = np.arange(rows["t"].iloc[0], rows["t"].iloc[-1] + dt / 4, dt)
    if len(rows) < 4 or len(t) < 4:
        return pd.DataFrame(columns=["t", "speed", *[f"x{k}" for k in range(12)]], dtype=float)
    yaw = np.interp(t, rows["t"], np.unwrap(np.radians(90 - rows["angle"])))
    speed = np.maximum(0, np.interp(t, rows["t"], rows["speed"]))
    pull = np.gradient(np.c_[speed * np.cos(yaw), speed * np.sin(yaw), np.zeros(len(t))], dt, axis=0, edge_order=2)
    mount = np.array(rotation_zyx(*rng.uniform(-1, 1, 3) * [math.radians(35), math.radians(35), math.pi]))
    c, s = np.cos(yaw), np.sin(yaw)
    in_vehicle = lambda v: np.c_[c * v[:, 0] + s * v[:, 1], c * v[:, 1] - s * v[:, 0], v[:, 2]] @ mount
    flat = np.zeros((len(t), 3))
    gravity, turn = flat + [0, 0, GRAVITY], flat.copy()
    turn[:, 2] = np.gradient(yaw, dt, edge_order=2)
    walk = lambda scale: np.cumsum(rng.normal(0, scale * math.sqrt(dt), flat.shape), axis=0)
    shake = np.sin(2 * math.pi * t[:, None] * rng.uniform(0.5, min(4.5, 0.45 * hz), 3) + rng.uniform(-math.pi, math.pi, 3)) * rng.uniform(0.03, 0.7, 3)
    linear = in_vehicle(pull) + rng.normal(0, 0.12, 3) + walk(0.003) + rng.normal(0, 0.08, flat.shape) + shake
    gravity = in_vehicle(gravity) + rng.normal(0, 0.025, flat.shape)
    rate = in_vehicle(turn) + rng.normal(0, 0.012, 3) + walk(0.0003) + rng.normal(0, 0.002, flat.shape)
    out = np.c_[t, speed, linear + gravity, gravity, linear, rate[:, ::-1]]
    return pd.DataFrame(out, columns=["t", "speed", *[f"x{k}" for k in range(12)]])


def synthesise(trajectories: DataFrame, key: str = "vehicle", hz: float = 10.0, seed: int = 0) -> DataFrame:
    """``synthetic_recorder`` over all trajectories (key, t, angle, speed), each with a seed from its key."""
    import zlib

    kind = trajectories.schema[key].dataType.simpleString()

    def run(own: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = synthetic_recorder(rows, hz, seed + zlib.crc32(str(own[0]).encode()))
        out.insert(0, key, pd.Series([own[0]] * len(out), dtype=object if isinstance(own[0], str) else None))
        return out

    return trajectories.select(key, "t", "angle", "speed").groupBy(key).applyInPandas(run, f"{key} {kind}, t double, speed double, " + ", ".join(f"x{k} double" for k in range(12)))
