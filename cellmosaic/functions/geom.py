"""Polygons: read on the driver, tested in Column expressions."""

from __future__ import annotations

import json
import re
import struct
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]
FEW_EDGES = 64


def rings_from_wkt(wkt: str) -> list[Ring]:
    """All rings of a POLYGON or MULTIPOLYGON."""
    if not re.match(r"\s*(MULTI)?POLYGON", wkt, re.I):
        raise ValueError("POLYGON or MULTIPOLYGON")
    return [[tuple(map(float, p.split()[:2])) for p in ring.split(",")] for ring in re.findall(r"\(([^()]+)\)", wkt)]


def rings_from_geojson(text: str) -> list[Ring]:
    """All rings of a GeoJSON geometry, feature or collection."""
    found: list[Ring] = []

    def take(node):
        if node["type"] == "FeatureCollection":
            for x in node["features"]:
                take(x)
        elif node["type"] == "Feature":
            take(node["geometry"])
        else:
            for polygon in [node["coordinates"]] if node["type"] == "Polygon" else node["coordinates"]:
                found.extend([(x, y) for x, y, *_ in ring] for ring in polygon)

    take(json.loads(text))
    return found


def bounds(rings: list[Ring]) -> tuple[float, float, float, float]:
    xs, ys = [x for r in rings for x, _ in r], [y for r in rings for _, y in r]
    return min(xs), min(ys), max(xs), max(ys)


def simplify(ring: Ring, tolerance: float = 1e-4) -> Ring:
    """Douglas and Peucker (1973): drops points nearer than ``tolerance`` to the line that stays."""
    if len(ring) < 3:
        return ring
    (ax, ay), (bx, by) = ring[0], ring[-1]
    length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
    off = [abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / length if length else ((x - ax) ** 2 + (y - ay) ** 2) ** 0.5 for x, y in ring]
    k = max(range(1, len(ring) - 1), key=lambda i: off[i])
    return [ring[0], ring[-1]] if off[k] <= tolerance else simplify(ring[: k + 1], tolerance)[:-1] + simplify(ring[k:], tolerance)


def centroid(ring: Ring) -> tuple[float, float]:
    pairs = list(zip(ring, ring[1:], strict=False))
    cross = [x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in pairs]
    area = sum(cross) / 2
    x = sum((p[0] + q[0]) * c for (p, q), c in zip(pairs, cross, strict=True)) / (6 * area)
    return x, sum((p[1] + q[1]) * c for (p, q), c in zip(pairs, cross, strict=True)) / (6 * area)


def representative_point(rings: list[Ring]) -> tuple[float, float]:
    """A point inside: the middle of the widest stretch on a line half-way up, or a little off it where that only touches corners."""
    x0, y0, x1, y1 = bounds(rings)
    for share in (0.5, 0.4871, 0.5233, 0.3719, 0.6417):
        y = y0 + (y1 - y0) * share
        cuts = sorted((bx - ax) / (by - ay) * (y - ay) + ax for r in rings for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True) if (ay > y) != (by > y))
        spans = [(b - a, (a + b) / 2) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
        if spans and max(spans)[0] > 0:
            return max(spans)[1], y
    raise ValueError("no area")


def union_all(polygons: list[list[Ring]]) -> list[Ring]:
    """The rings of polygons that don't overlap, as one outline: edges that two of them share go. Over overlapping ones the even-odd rule would leave out what is covered twice."""
    edges: dict[tuple, int] = {}
    for rings in polygons:
        for ring in rings:
            for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
                if p != q:
                    edges[p, q] = edges.get((p, q), 0) + 1
    left = [e for e in edges if (e[1], e[0]) not in edges]
    after: dict[tuple, list] = {}
    for p, q in left:
        after.setdefault(p, []).append(q)
    out: list[Ring] = []
    while after:
        start = next(iter(after))
        ring, at = [start], start
        while at in after:
            to = after[at].pop()
            if not after[at]:
                del after[at]
            ring.append(to)
            at = to
            if at == start:
                break
        out.append(ring)
    return out


def polygon_wkb(ring: Ring) -> bytes:
    return struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<dd", x, y) for x, y in ring)


def within_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lon.between(F.lit(box[0]), F.lit(box[2])) & lat.between(F.lit(box[1]), F.lit(box[3]))


def within(lon: Column, lat: Column, rings: list[Ring]) -> Column:
    """Even-odd test by a ray to the east. The box comes first, as a range that scans can prune by.

    Up to ``FEW_EDGES`` edges are terms of the expression, in generated code; those of a longer outline are one literal array that is gone through, so that the plan doesn't grow with it.
    """
    edges = [(y0, y1, (x1 - x0) / (y1 - y0), x0) for ring in rings for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True) if y0 != y1]

    def crosses(y0: Column, y1: Column, slope: Column, x0: Column) -> Column:
        return F.when(((y0 > lat) != (y1 > lat)) & (lon < slope * (lat - y0) + x0), 1).otherwise(0)

    if len(edges) <= FEW_EDGES:
        total = reduce(lambda a, b: a + b, [crosses(*map(F.lit, e)) for e in edges], F.lit(0))
    else:
        text = json.dumps([dict(zip(("y0", "y1", "slope", "x0"), e, strict=True)) for e in edges])
        literal = F.from_json(F.lit(text), "array<struct<y0: double, y1: double, slope: double, x0: double>>")
        total = F.aggregate(literal, F.lit(0), lambda n, e: n + crosses(e["y0"], e["y1"], e["slope"], e["x0"]))
    return within_box(lon, lat, bounds(rings)) & (total % 2 == 1)


def _cut(a, b, c, d) -> bool:
    def turn(p, q, r):
        v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return (v > 0) - (v < 0)

    return turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0


def inside(point: tuple[float, float], rings: list[Ring]) -> bool:
    x, y = point
    n = 0
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (y0 > y) != (y1 > y) and x < (x1 - x0) / (y1 - y0) * (y - y0) + x0
    return n % 2 == 1


def boxes_meet(minx: Column, miny: Column, maxx: Column, maxy: Column, rings: list[Ring]) -> Column:
    """The same test of boxes in columns: an edge passes through the box (slabs of its line's parameter), or the box lies inside."""
    tests = [within(minx, miny, rings)]
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            lo, hi = [F.lit(0.0)], [F.lit(1.0)]
            inside_ = []
            for a, d, low, high in ((ax, bx - ax, minx, maxx), (ay, by - ay, miny, maxy)):
                if d == 0:
                    inside_.append((low <= a) & (high >= a))
                else:
                    s, t = (low - F.lit(a)) / F.lit(d), (high - F.lit(a)) / F.lit(d)
                    lo.append(F.least(s, t))
                    hi.append(F.greatest(s, t))
            crosses = (F.greatest(*lo) <= F.least(*hi)) if len(lo) > 1 else F.lit(True)
            tests.append(reduce(lambda p, q: p & q, inside_, crosses))
    return reduce(lambda p, q: p | q, tests)


def box_meets(box: tuple[float, float, float, float], rings: list[Ring]) -> bool:
    """Whether a box and a polygon share a point."""
    x0, y0, x1, y1 = box
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    if inside(corners[0], rings) or any(x0 <= x <= x1 and y0 <= y <= y1 for r in rings for x, y in r):
        return True
    sides = list(zip(corners, corners[1:] + corners[:1], strict=True))
    return any(_cut(p, q, a, b) for r in rings for p, q in zip(r, r[1:] + r[:1], strict=True) for a, b in sides)
