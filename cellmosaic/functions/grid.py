"""A hierarchical equal-area grid of the sphere, as Column expressions.

Cylindrical equal-area: ``10 * 2^(L-1)`` columns of longitude and ``6 * 2^(L-1)`` rows of the sine of latitude. An id is face, Morton bits of
the place in the face, a closing 1, and zeros up to level 26: children of a cell are one range of ids, and nearby cells mostly have
nearby ids, so sorted files prune well.

Bits are spread by reading a number's binary digits in base 4, and gathered the other way round: expressions stay short, where shift-and-mask
steps would name their argument twice each, 32 times in all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellmosaic.config import EARTH_RADIUS_M

TOP = 26


def _long(x) -> Column:
    return F.lit(x).cast("long")


def size(level: int) -> tuple[int, int]:
    """Columns and rows of a level."""
    if not 1 <= level <= TOP:
        raise ValueError(f"level is 1 to {TOP}")
    return 10 << (level - 1), 6 << (level - 1)


def grid_xy(lon: Column, lat: Column, level: int) -> tuple[Column, Column]:
    """Column and row of a point; longitude wraps, the poles are clipped."""
    nx, ny = size(level)
    ix = F.floor((lon + F.lit(180.0)) / F.lit(360.0) * F.lit(float(nx)))
    iy = F.floor((F.sin(F.radians(lat)) + F.lit(1.0)) / F.lit(2.0) * F.lit(float(ny)))
    return F.pmod(ix, _long(nx)), F.greatest(_long(0), F.least(iy, _long(ny - 1)))


def _spread(x: Column) -> Column:
    """Each bit of ``x`` on every other bit."""
    return F.conv(F.bin(x), 4, 10).cast("long")


def _gather(x: Column, bits: int) -> Column:
    """Every other bit of the low ``bits`` of ``x``, side by side."""
    even = sum(1 << i for i in range(0, bits, 2))
    return F.conv(F.conv(x.bitwiseAND(_long(even)).cast("string"), 10, 4), 2, 10).cast("long")


def xy_to_cell(ix: Column, iy: Column, level: int) -> Column:
    k = level - 1
    low = _long((1 << k) - 1)
    x, y = (_spread(v.bitwiseAND(low)) for v in (ix, iy))
    face = F.shiftright(ix, k) * 6 + F.shiftright(iy, k)
    body = F.shiftleft(face, 2 * k).bitwiseOR(x).bitwiseOR(F.shiftleft(y, 1))
    return F.shiftleft(F.shiftleft(body, 1).bitwiseOR(_long(1)), 2 * (TOP - level))


def point_to_cell(lon: Column, lat: Column, level: int) -> Column:
    return xy_to_cell(*grid_xy(lon, lat, level), level)


def _interleave(x: int, y: int) -> int:
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(max(x, y, 1).bit_length()))


def id_of(ix: int, iy: int, level: int) -> int:
    """The id of one place of the grid, on the driver: for literals that a scan can prune by."""
    k = level - 1
    low = (1 << k) - 1
    body = ((ix >> k) * 6 + (iy >> k)) << 2 * k | _interleave(ix & low, iy & low)
    return (body << 1 | 1) << 2 * (TOP - level)


def xy_of(lon: float, lat: float, level: int) -> tuple[int, int]:
    nx, ny = size(level)
    return math.floor((lon + 180.0) / 360.0 * nx) % nx, max(0, min(ny - 1, math.floor((math.sin(math.radians(lat)) + 1.0) / 2.0 * ny)))


def cell_of(lon: float, lat: float, level: int) -> int:
    return id_of(*xy_of(lon, lat, level), level)


def disk_of(cell_xy_: tuple[int, int], level: int, k: int) -> list[int]:
    """The ids of ``grid_disk`` around one place, sorted."""
    nx, ny = size(level)
    x, y = cell_xy_
    return sorted({id_of((x + dx) % nx, y + dy, level) for dy in range(-k, k + 1) for dx in range(abs(dy) - k, k - abs(dy) + 1) if 0 <= y + dy < ny})


def cover(box: tuple[float, float, float, float], level: int, most: int = 64) -> list[tuple[int, int]]:
    """At most ``most`` ranges of ids that hold every cell of ``level`` whose centre may lie in a box (west, south, east, north; not over the date line)."""
    (x0, y0), (x1, y1) = xy_of(box[0], box[1], level), xy_of(min(box[2], 180 - 1e-9), box[3], level)
    step = 0
    while ((x1 >> step) - (x0 >> step) + 1) * ((y1 >> step) - (y0 >> step) + 1) > most and step < level - 1:
        step += 1
    found = []
    for x in range(x0 >> step, (x1 >> step) + 1):
        for y in range(y0 >> step, (y1 >> step) + 1):
            whole = id_of(x, y, level - step)
            half = (1 << 2 * (TOP - level + step)) - 1
            found.append((whole - half, whole + half))
    found.sort()
    out = found[:1]
    for lo, hi in found[1:]:
        if lo <= out[-1][1] + 2:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def cell_xy(cell: Column, level: int) -> tuple[Column, Column]:
    k = level - 1
    body = F.shiftright(cell, 2 * (TOP - level) + 1)
    face = F.shiftright(body, 2 * k)
    x, y = _gather(body, 2 * k), _gather(F.shiftright(body, 1), 2 * k)
    return F.shiftleft(F.floor(face / 6).cast("long"), k).bitwiseOR(x), F.shiftleft(F.pmod(face, _long(6)), k).bitwiseOR(y)


def xy_to_point(ix: Column, iy: Column, level: int) -> tuple[Column, Column]:
    """Longitude and latitude of a place in the grid: add 0.5 to both for a cell's centre."""
    nx, ny = size(level)
    lon = ix / F.lit(float(nx)) * F.lit(360.0) - F.lit(180.0)
    return lon, F.degrees(F.asin(iy / F.lit(float(ny)) * F.lit(2.0) - F.lit(1.0)))


def cell_to_point(cell: Column, level: int) -> Column:
    """``struct<lon, lat>`` of the centre; latitude is rounded to 9 places, where libraries agree."""
    ix, iy = cell_xy(cell, level)
    lon, lat = xy_to_point(ix + F.lit(0.5), iy + F.lit(0.5), level)
    return F.struct(lon.alias("lon"), F.round(lat, 9).alias("lat"))


def cell_ring(cell: Column, level: int) -> Column:
    """The cell's corners, counter-clockwise and closed, as ``array<struct<x, y>>``."""
    ix, iy = cell_xy(cell, level)
    corner = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    points = [xy_to_point(ix + dx, iy + dy, level) for dx, dy in corner]
    return F.array(*[F.struct(F.round(x, 9).alias("x"), F.round(y, 9).alias("y")) for x, y in points])


def ring_wkt(ring: Column) -> Column:
    pair = F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("POLYGON (("), F.array_join(pair, ", "), F.lit("))"))


def parent(cell: Column, level: int, to: int) -> Column:
    """The cell of level ``to`` that holds a cell of ``level``."""
    if to > level:
        raise ValueError("a parent's level is not above the cell's")
    close = 2 * (TOP - to)
    return F.shiftleft(F.shiftright(cell, close + 1), close + 1).bitwiseOR(_long(1 << close))


def children_range(cell: Column, level: int) -> tuple[Column, Column]:
    """The least and largest id of all descendants."""
    half = (1 << (2 * (TOP - level))) - 1
    return cell - _long(half), cell + _long(half)


def grid_disk(cell: Column, level: int, k: int) -> Column:
    """All cells within k steps over edges, as an array; ``1 + 2k(k + 1)`` of them away from the poles."""
    nx, ny = size(level)
    ix, iy = cell_xy(cell, level)
    steps = [(dx, dy) for dy in range(-k, k + 1) for dx in range(abs(dy) - k, k - abs(dy) + 1)]
    offsets = F.array(*[F.struct(_long(dx).alias("dx"), _long(dy).alias("dy")) for dx, dy in steps])
    inside = F.filter(offsets, lambda o: (iy + o["dy"] >= 0) & (iy + o["dy"] < ny))
    return F.array_sort(F.array_distinct(F.transform(inside, lambda o: xy_to_cell(F.pmod(ix + o["dx"], _long(nx)), iy + o["dy"], level))))


def cell_area_m2(level: int) -> float:
    """The area of every cell of a level."""
    return 4 * math.pi * EARTH_RADIUS_M**2 / (60 * 4 ** (level - 1))


def block_id(lon: Column, lat: Column, degrees: float = 0.05) -> Column:
    """The split block: whole degrees' parts of longitude and latitude in one number."""
    return (F.floor(lon / F.lit(degrees)) * 100000 + F.floor(lat / F.lit(degrees))).cast("long")


def is_test(block: Column, seed: int = 42, permille: int = 250) -> Column:
    """Whether a block is held out; a function of the block alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), block.cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % 1000 < permille
