"""Scalar functions over columns. Angles are in radians from East counter-clockwise unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radii in metres (ellipsoid axis; sphere), standard gravity.
AXIS, SPHERE, GRAVITY = 6378137.0, 6371000.0, 9.80665
PI = 3.141592653589793


def floor_mod(a: Column, b: float) -> Column:
    return F.pmod(a.cast("double"), F.lit(float(b)))


def wrap(angle: Column) -> Column:
    """The angle in [-pi, pi)."""
    return floor_mod(angle + PI, 2 * PI) - PI


def course_to_heading(course_deg: Column) -> Column:
    """Degrees clockwise from North as a wrapped heading."""
    return wrap(F.lit(PI / 2) - F.radians(course_deg))


def heading_to_course(heading: Column) -> Column:
    return floor_mod(F.lit(90.0) - F.degrees(heading), 360.0)


def heading_gap(a_deg: Column, b_deg: Column) -> Column:
    """Smallest absolute difference of two courses in degrees."""
    return F.abs(floor_mod(a_deg - b_deg + 180.0, 360.0) - 180.0)


def _haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    north, east = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return north * north + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * east * east


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = SPHERE) -> Column:
    """Great-circle distance by the two-argument arc tangent."""
    a = _haversine(lat1, lon1, lat2, lon2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_clipped(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = SPHERE) -> Column:
    """Great-circle distance by the arc sine, its argument kept in range."""
    return 2 * radius * F.asin(F.sqrt(clip(_haversine(lat1, lon1, lat2, lon2), 0.0, 1.0)))


def to_local(lat: Column, lon: Column, lat0: Column, lon0: Column, radius: float = AXIS) -> tuple[Column, Column]:
    """Metres east and north of an origin on its tangent plane."""
    return F.radians(lon - lon0) * radius * F.cos(F.radians(lat0)), F.radians(lat - lat0) * radius


def from_local(east: Column, north: Column, lat0: Column, lon0: Column, radius: float = AXIS) -> tuple[Column, Column]:
    """Latitude and longitude of a point on the tangent plane; near the poles the cosine is held at 1e-6."""
    return lat0 + F.degrees(north / radius), lon0 + F.degrees(east / (radius * F.greatest(F.lit(1e-6), F.cos(F.radians(lat0)))))


def bearing(east: Column, north: Column) -> Column:
    """Degrees clockwise from North of a displacement, in [0, 360)."""
    return floor_mod(F.degrees(F.atan2(east, north)), 360.0)


def mercator_pixel(lat: Column, lon: Column, zoom: int, tile: int = 256) -> tuple[Column, Column]:
    """Web-Mercator pixel of a coordinate at a zoom level."""
    size = float(tile * 2**zoom)
    s = F.sin(F.radians(lat))
    return (lon + 180.0) / 360.0 * size, (0.5 - F.log((1 + s) / (1 - s)) / (4 * PI)) * size


def mercator_inverse(x: Column, y: Column, zoom: int, tile: int = 256) -> tuple[Column, Column]:
    size = float(tile * 2**zoom)
    return F.degrees(F.atan(F.sinh(PI * (1 - 2 * y / size)))), x / size * 360.0 - 180.0


#: Factors to m/s2, rad/s, s and m/s (fixed values).
UNITS = {"m/s2": 1.0, "g": GRAVITY, "rad/s": 1.0, "deg/s": PI / 180, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9, "m/s": 1.0, "km/h": 1 / 3.6}


def in_base_unit(value: Column, unit: Column) -> Column:
    """The value times its unit's factor; an unknown unit gives null."""
    out = F.lit(None).cast("double")
    for name, factor in UNITS.items():
        out = F.when(unit == name, value * factor).otherwise(out)
    return out


def dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(a: list[Column], floor: float = 1e-9) -> list[Column]:
    """The vector over its norm, which counts as ``floor`` at least."""
    n = F.greatest(norm(a), F.lit(floor))
    return [x / n for x in a]


def rotate(matrix: list[list[float]], v: list[Column]) -> list[Column]:
    """A constant 3 x 3 matrix times a vector of columns."""
    return [dot([F.lit(float(x)) for x in row], v) for row in matrix]


def rotation_zyx(roll: float, pitch: float, yaw: float) -> list[list[float]]:
    """Rz(yaw) Ry(pitch) Rx(roll)."""
    import numpy as np

    (cr, sr), (cp, sp), (cy, sy) = ((np.cos(x), np.sin(x)) for x in (roll, pitch, yaw))
    about_x, about_y, about_z = [[1, 0, 0], [0, cr, -sr], [0, sr, cr]], [[cp, 0, sp], [0, 1, 0], [-sp, 0, cp]], [[cy, -sy, 0], [sy, cy, 0], [0, 0, 1]]
    return (np.array(about_z) @ np.array(about_y) @ np.array(about_x)).tolist()


def normal(*names: Column) -> Column:
    """A standard normal number that follows from what names it alone: the same in any task and any order of rows."""
    share = lambda k: (F.pmod(F.xxhash64(*names, F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(share(1))) * F.cos(2 * PI * share(2))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def number(text: Column) -> Column:
    """Text as a finite double; anything else is null."""
    x = F.trim(text).try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def seconds_of_day(stamp: Column) -> Column:
    micros = F.date_part(F.lit("SECOND"), stamp).cast("double")
    return F.hour(stamp) * 3600.0 + F.minute(stamp) * 60.0 + micros


def project_to_segment(e: Column, n: Column, e1: Column, n1: Column, e2: Column, n2: Column) -> tuple[Column, Column, Column, Column]:
    """(fraction in [0, 1], east, north, distance) of the nearest point of a segment; a segment of no length is its start."""
    de, dn = e2 - e1, n2 - n1
    length = de * de + dn * dn
    f = F.when(length > 0, clip(((e - e1) * de + (n - n1) * dn) / length, 0.0, 1.0)).otherwise(F.lit(0.0))
    pe, pn = e1 + f * de, n1 + f * dn
    return f, pe, pn, F.sqrt((e - pe) * (e - pe) + (n - pn) * (n - pn))


def turn_instruction(change_deg: Column) -> Column:
    """What to say at a bend of so many degrees, right positive."""
    return F.when(F.abs(change_deg) >= 150, "U-turn").when(change_deg >= 30, "Turn right").when(change_deg <= -30, "Turn left").otherwise("Continue")


def contains_ignoring_case(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def capability_profile(accelerometer: Column, gyroscope: Column, gravity: Column) -> Column:
    """What a device can do with the sensors it has."""
    return F.when(accelerometer & gyroscope & gravity, "full").when(accelerometer & gyroscope, "degraded").otherwise("gnss_only")


#: Families by the first prefix that fits, in this order (fixed values).
FAMILIES = ("Vfa", "Vfb", "Vta", "Vtb", "Vw", "S", "M", "Y")


def drive_family(name: Column) -> Column:
    """The first family whose name begins the drive's; else "other"."""
    out = F.lit("other")
    for family in reversed(FAMILIES):
        out = F.when(name.startswith(family), family).otherwise(out)
    return out
