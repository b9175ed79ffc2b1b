"""From pixels to cells: aggregation, merging of overlapping tiles, majorities, purity and spread.

Every aggregate is by cell id with partial sums, so a cell that holds many pixels is a few rows after the map side. Majorities are counts by
(cell, label) and a ``max_by`` on (count, -label): the lowest label wins a tie, whatever the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.config import BANDS
from cellmosaic.functions.grid import cell_to_point, point_to_cell
from cellmosaic.functions.spectral import is_valid


def index_pixels(pixels: DataFrame, level: int) -> DataFrame:
    """Valid pixels with their cell; a narrow transformation."""
    return pixels.filter(is_valid()).withColumn("cell_id", point_to_cell(F.col("lon"), F.col("lat"), level))


def with_centres(cells: DataFrame, level: int) -> DataFrame:
    """Adds ``lon, lat`` of the cells' centres. Stored with the cells, they are what maps, zones and splits filter by: an id is not taken apart again in a query."""
    return cells.withColumn("_p", cell_to_point(F.col("cell_id"), level)).select("*", "_p.lon", "_p.lat").drop("_p")


def majority(rows: DataFrame, keys: list[str], value: str, *more: Column) -> DataFrame:
    """The most frequent value by ``keys``, and other sums; one row a (keys, value) goes on to the second step."""
    per = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), *more)
    return per.groupBy(*keys).agg(
        F.sum("_n").alias("n_pixels"), F.max_by(value, F.struct("_n", -F.col(value))).alias(value), F.max("_n").alias("_most"),
        *[F.sum(c).alias(c) for c in per.columns[len(keys) + 2 :]],
    )


def cell_aggregate(indexed: DataFrame, keys: tuple[str, ...] = ("tile", "cell_id")) -> DataFrame:
    """By tile and cell: ``n_pixels``, band means as floats, majority ``label`` (0 counts too)."""
    sums = majority(indexed, list(keys), "label", *[F.expr(f"sum(cast({b} as bigint)) as {b}") for b in BANDS])
    return sums.selectExpr(*keys, "n_pixels", *[f"cast({b} / n_pixels as float) as {b}" for b in BANDS], "label")


def cell_dedup(cells: DataFrame) -> DataFrame:
    """One row a cell over overlapping tiles: pixels summed, means weighted by them, the tiles' most frequent majority, the tile with the most pixels.

    A cell has a row a tile, so nothing is to gain by partial sums: rows are dealt by cell once, and both steps run there.
    """
    keyed = cells.repartition("cell_id").selectExpr("cell_id", "label", "tile", "n_pixels", *[f"cast({b} * cast(n_pixels as float) as float) as {b}" for b in BANDS])
    sums = [F.expr(f"sum({b}) as {b}") for b in BANDS]
    per = keyed.groupBy("cell_id", "label").agg(F.expr("count(*) as _n"), F.expr("sum(n_pixels) as n_pixels"), F.expr("max(struct(n_pixels, tile)) as _top"), *sums)
    out = per.groupBy("cell_id").agg(F.expr("max_by(label, struct(_n, -label)) as label"), F.expr("sum(n_pixels) as n_pixels"), F.expr("max(_top) as _top"), *sums)
    return out.selectExpr("cell_id", "n_pixels", *[f"cast({b} / n_pixels as float) as {b}" for b in BANDS], "label", "_top.tile as tile")


def raster_majority(indexed: DataFrame, value: str = "label", nodata: int = 0) -> DataFrame:
    """By cell over all tiles: the most frequent value that isn't ``nodata``, and how many pixels have one."""
    return majority(indexed.filter(F.col(value) != nodata), ["cell_id"], value).select("cell_id", F.col(value).alias("value"), "n_pixels")


def cell_stats(indexed: DataFrame, band: str = "B08") -> DataFrame:
    """By cell: pixels, share of the most frequent label, mean and population deviation of a band. All from one shuffle of integer sums."""
    x = F.col(band).cast("long")
    sums = majority(indexed, ["cell_id"], "label", F.sum(x).alias("_x"), F.sum(x * x).alias("_xx"))
    n = F.col("n_pixels")
    spread = F.sqrt((n * F.col("_xx") - F.col("_x") * F.col("_x")).cast("double")) / n
    return sums.select("cell_id", "n_pixels", (F.col("_most") / n).alias("label_purity"), spread.alias("b08_std"), (F.col("_x") / n).alias("b08_mean"))
