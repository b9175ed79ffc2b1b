"""Web Mercator (EPSG:3857) in closed form, as Column expressions and on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6378137.0


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north of a point in degrees."""
    return F.radians(lon) * F.lit(RADIUS_M), F.log(F.tan(F.radians(lat) / F.lit(2.0) + F.lit(math.pi / 4))) * F.lit(RADIUS_M)


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / F.lit(RADIUS_M)), F.degrees(F.atan(F.exp(y / F.lit(RADIUS_M))) * F.lit(2.0) - F.lit(math.pi / 2))


def point_to_mercator(lon: float, lat: float) -> tuple[float, float]:
    return math.radians(lon) * RADIUS_M, math.log(math.tan(math.radians(lat) / 2 + math.pi / 4)) * RADIUS_M


def point_from_mercator(x: float, y: float) -> tuple[float, float]:
    return math.degrees(x / RADIUS_M), math.degrees(2 * math.atan(math.exp(y / RADIUS_M)) - math.pi / 2)


def box_from_mercator(box: tuple[float, float, float, float], points: int = 21) -> tuple[float, float, float, float]:
    """The box in degrees around a box in metres, from points along its edges."""
    x0, y0, x1, y1 = box
    share = [k / (points - 1) for k in range(points)]
    edge = [(x0 + (x1 - x0) * s, y) for s in share for y in (y0, y1)] + [(x, y0 + (y1 - y0) * s) for s in share for x in (x0, x1)]
    found = [point_from_mercator(x, y) for x, y in edge]
    return min(x for x, _ in found), min(y for _, y in found), max(x for x, _ in found), max(y for _, y in found)
