"""Invariants of the grid and the split."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic.functions import grid


@pytest.fixture(scope="module")
def points(spark):
    n = 20_000
    lon, lat = np.linspace(-5.7, 1.7, n), np.linspace(50.0, 55.8, n)
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(lon, lat, strict=True))], "row_id long, lon double, lat double")


def test_order_of_rows_does_not_matter(points):
    n = points.count()
    there = points.select("row_id", grid.point_to_cell(F.col("lon"), F.col("lat"), 18).alias("a"))
    back = points.select((n - 1 - F.col("row_id")).alias("row_id"), "lon", "lat").orderBy("row_id").select((n - 1 - F.col("row_id")).alias("row_id"), grid.point_to_cell(F.col("lon"), F.col("lat"), 18).alias("b"))
    assert there.join(back, "row_id").filter("a <> b").count() == 0


@pytest.mark.parametrize("level", [1, 2, 9, 14, 18, 26])
def test_centres_parents_and_ranges(spark, level):
    own = spark.range(3000).select((F.rand(1) * 360 - 180).alias("lon"), F.degrees(F.asin(F.rand(2) * 2 - 1)).alias("lat"))
    own = own.withColumn("cell", grid.point_to_cell(F.col("lon"), F.col("lat"), level)).persist()
    x, y = grid.cell_xy(F.col("cell"), level)
    px, py = grid.grid_xy(F.col("lon"), F.col("lat"), level)
    assert own.filter((x != px) | (y != py)).count() == 0
    if level < 20:
        p = grid.cell_to_point(F.col("cell"), level)
        assert own.filter(grid.point_to_cell(p["lon"], p["lat"], level) != F.col("cell")).count() == 0
    if level > 1:
        up = grid.parent(F.col("cell"), level, level - 1)
        lo, hi = grid.children_range(up, level - 1)
        assert own.filter((up != grid.point_to_cell(F.col("lon"), F.col("lat"), level - 1)) | ~F.col("cell").between(lo, hi)).count() == 0
    own.unpersist()


def test_cells_cover_the_sphere_equally():
    for level in (1, 5, 18):
        nx, ny = grid.size(level)
        assert grid.cell_area_m2(level) * nx * ny == pytest.approx(4 * math.pi * 6371007.1809**2)
    assert grid.cell_area_m2(18) == pytest.approx(494.83, abs=0.01)


def test_disk(spark):
    for k in (0, 1, 8):
        disk = spark.range(1).select(grid.grid_disk(grid.point_to_cell(F.lit(179.9999), F.lit(51.5), 12), 12, k)).first()[0]
        assert len(set(disk)) == 1 + 2 * k * (k + 1)


def test_ring_and_wkt(spark):
    cell = grid.point_to_cell(F.lit(-0.13), F.lit(51.5), 10)
    ring, wkt = spark.range(1).select(grid.cell_ring(cell, 10), grid.ring_wkt(grid.cell_ring(cell, 10))).first()
    assert ring[0] == ring[-1] and len(ring) == 5 and wkt.startswith("POLYGON ((") and ring[0]["x"] <= -0.13 <= ring[1]["x"] and ring[0]["y"] <= 51.5 <= ring[2]["y"]


def test_split_is_a_function_of_the_block(spark):
    rows = spark.createDataFrame([(-0.13, 51.52), (0.0, 0.0), (-179.99, -89.9)], "lon double, lat double")
    for r in rows.withColumn("b", grid.block_id(F.col("lon"), F.col("lat"))).withColumn("t", grid.is_test(F.col("b"))).collect():
        assert r["b"] == math.floor(r["lon"] / 0.05) * 100000 + math.floor(r["lat"] / 0.05)
        assert r["t"] == (int(hashlib.md5(f"42:{r['b']}".encode()).hexdigest()[:8], 16) % 1000 < 250)
    assert math.floor(-0.13 / 0.05) == -3
