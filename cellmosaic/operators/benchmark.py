"""The paired benchmark: four questions, each put to the cells and to the pixels, and what both take to store."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.functions import grid
from cellmosaic.functions.geom import Ring, bounds, representative_point, within
from cellmosaic.operators.cells import cell_dedup
from cellmosaic.sources import store


def best_of(run: Callable[[], DataFrame], times: int) -> float:
    """The least seconds of some runs, results taken in full and thrown away."""
    found = []
    for _ in range(times):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        found.append(time.perf_counter() - began)
    return min(found)


def questions(cells: DataFrame, pixels: DataFrame, rings: list[Ring], level: int, k: int = 8, half: float = 0.0025) -> dict[str, tuple[Callable[[], DataFrame], Callable[[], DataFrame]]]:
    """By name: the question to stored cells (``cell_id, tile, lon, lat``, bands, ``label``) and to pixels (``lon, lat``, bands, ``label``). About the polygon and a point in it."""
    x, y = representative_point(rings)
    disk = grid.disk_of(grid.xy_of(x, y, level), level, k)
    ranges = reduce(lambda a, b: a | b, [F.col("cell_id").between(lo, hi) for lo, hi in grid.cover(bounds(rings), level)])
    inside = within(F.col("lon"), F.col("lat"), rings)
    near = lambda c, at, d: F.col(c).between(at - d, at + d)
    sums = [F.count("*").alias("n"), F.avg(F.col("B08").cast("double")).alias("b08")]
    step = 0.0001  # a pixel holds the point if its centre is nearer than any other: the nearest one of a small window
    nearest = (F.col("lon") - x) * (F.col("lon") - x) + (F.col("lat") - y) * (F.col("lat") - y)
    return {
        "point_lookup": (
            lambda: cell_dedup(cells.filter(F.col("cell_id") == grid.cell_of(x, y, level))).select("B04", "B08"),
            lambda: pixels.filter(near("lon", x, 20 * step) & near("lat", y, 20 * step)).orderBy(nearest).limit(1).select("B04", "B08"),
        ),
        "neighbourhood": (
            lambda: cell_dedup(cells.filter(F.col("cell_id").between(disk[0], disk[-1]) & F.col("cell_id").isin(disk))).agg(*sums),
            lambda: pixels.filter(near("lon", x, half) & near("lat", y, half) & (F.col("label") > 0)).agg(*sums),
        ),
        "zonal_aoi": (lambda: cell_dedup(cells.filter(ranges & inside)).agg(*sums), lambda: pixels.filter(inside & (F.col("B08") > 0)).agg(*sums)),
        "group_by_class": (lambda: cells.groupBy("label").agg(sums[1]), lambda: pixels.filter("label > 0").groupBy("label").agg(sums[1])),
    }


def run(spark: SparkSession, cells: DataFrame, pixels: DataFrame, rings: list[Ring], level: int, stored: dict[str, str] | None = None, times: int = 3) -> dict:
    """Seconds of each question on cells and pixels (the least of ``times``), and bytes of what is ``stored``, by name and path."""
    out: dict = {"level": level, "queries": {}, "storage_bytes": {name: store.stored_bytes(spark, path) for name, path in (stored or {}).items()}}
    for name, (of_cells, of_pixels) in questions(cells, pixels, rings, level).items():
        out["queries"][name] = {"cells_s": best_of(of_cells, times), "pixels_s": best_of(of_pixels, times)}
    return out


def table(result: dict) -> str:
    """Markdown: each question's seconds and how many times longer the pixels take."""
    rows = ["| query | pixels (s) | cells (s) | pixels / cells |", "| --- | --- | --- | --- |"]
    for name, x in result["queries"].items():
        rows.append(f"| {name} | {x['pixels_s']:.4f} | {x['cells_s']:.4f} | {x['pixels_s'] / x['cells_s'] if x['cells_s'] else float('inf'):.1f} |")
    return "\n".join(rows)
