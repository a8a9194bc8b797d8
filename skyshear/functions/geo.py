"""Column expressions of radar geometry; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyshear.model import EARTH_A, EARTH_F


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(c, digits) + F.lit(0.0)


def exact_sum(c: Column, digits: int = 9) -> Column:
    """The sum of values rounded to ``digits`` places, added as decimals, so that it doesn't depend on their order."""
    return F.sum(F.round(c, digits).cast(f"decimal({15 + digits},{digits})")).cast("double")


def nonzero(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def wgs84_to_enu(lat: Column, lon: Column, height_m: Column, lat0: float, lon0: float, height0_m: float) -> tuple[Column, Column, Column]:
    """East, north, up in km of a place, seen from an origin."""
    e2 = EARTH_F * (2 - EARTH_F)

    def ecef(la, lo, h, sin, cos):  # noqa: ANN001, ANN202
        n = EARTH_A / ((1 - e2 * sin(la) * sin(la)) ** 0.5 if sin is math.sin else F.sqrt(1 - e2 * sin(la) * sin(la)))
        return (n + h) * cos(la) * cos(lo), (n + h) * cos(la) * sin(lo), (n * (1 - e2) + h) * sin(la)

    la0, lo0 = math.radians(lat0), math.radians(lon0)
    x, y, z = ecef(F.radians(lat), F.radians(lon), height_m / 1000.0, F.sin, F.cos)
    x0, y0, z0 = ecef(la0, lo0, height0_m / 1000.0, math.sin, math.cos)
    dx, dy, dz = x - x0, y - y0, z - z0
    east = dx * -math.sin(lo0) + dy * math.cos(lo0)
    north = dx * (-math.sin(la0) * math.cos(lo0)) + dy * (-math.sin(la0) * math.sin(lo0)) + dz * math.cos(la0)
    up = dx * (math.cos(la0) * math.cos(lo0)) + dy * (math.cos(la0) * math.sin(lo0)) + dz * math.sin(la0)
    return east, north, up


def enu_to_lonlat(x_km: Column, y_km: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Longitude and latitude with 111.32 km a degree at the origin's latitude."""
    return lon0 + x_km / (111.32 * math.cos(math.radians(lat0))), lat0 + y_km / 111.32


def feature_to_xy(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """East and north in km with 111 km a degree at the place's own latitude."""
    return (lon - lon0) * 111.0 * F.cos(F.radians(lat)), (lat - lat0) * 111.0


def stretched(z: Column, scale: float) -> Column:
    """Heights of a scene, exaggerated."""
    return z * scale


def cosines(azimuth_deg: Column, elevation_deg: Column) -> tuple[Column, Column, Column]:
    """East, north, up components of a beam: azimuth clockwise from north, elevation upwards."""
    az, el = F.radians(azimuth_deg), F.radians(elevation_deg)
    return F.cos(el) * F.sin(az), F.cos(el) * F.cos(az), F.sin(el)


def unit_to(x: Column, y: Column, z: Column, radar: tuple[float, float, float]) -> tuple[Column, Column, Column, Column]:
    """Unit vector from a radar to a place, and the range; null at the radar itself."""
    dx, dy, dz = x - radar[0], y - radar[1], z - radar[2]
    r = F.sqrt(dx * dx + dy * dy + dz * dz)
    return dx / nonzero(r), dy / nonzero(r), dz / nonzero(r), r


def azimuth(east: Column, north: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def wrapped(a: Column, b: Column) -> Column:
    """Absolute difference of two directions in degrees, at most 180."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def crossing_angle(bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    """Angle in degrees, at most 90, between the horizontal parts of two beams."""
    norm = F.sqrt((bx1 * bx1 + by1 * by1) * (bx2 * bx2 + by2 * by2))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs((bx1 * bx2 + by1 * by2) / nonzero(norm)))))


def horizontal_sigmas(bx1: Column, by1: Column, bx2: Column, by2: Column) -> tuple[Column, Column]:
    """Least and largest singular value of the two beams' horizontal parts, by the eigenvalues of their Gram matrix."""
    a, b, c = bx1 * bx1 + bx2 * bx2, bx1 * by1 + bx2 * by2, by1 * by1 + by2 * by2
    root = F.sqrt((a - c) * (a - c) + 4 * b * b)
    return F.sqrt(F.greatest(F.lit(0.0), (a + c - root) / 2)), F.sqrt(F.greatest(F.lit(0.0), (a + c + root) / 2))


def cross(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]
