"""A deterministic pixel table from ``lineitem``: 250 by 240 pixels of 0.002 degrees, four overlapping tiles, integer bands.

Pixels, cells, statistics and predictions are datasets at rest, as in a real project: the first query that needs one writes it, sorted, and all read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.config import BANDS, PERIODS
from cellmosaic.functions.grid import cell_xy
from cellmosaic.functions.spectral import class_of
from cellmosaic.operators import metrics
from cellmosaic.operators import cells as ops
from cellmosaic.operators.pixels import centre
from cellmosaic.sources import store

LEVEL, WEST, NORTH, STEP = 14, -0.5, 51.7, 0.002


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tile, r, c, lon, lat``, bands, ``wc_code`` and ``label``; every 37th diagonal is nodata."""
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    raw = own.select(
        F.concat(F.lit("T"), (F.col("l_suppkey") % 4).cast("string")).alias("tile"), (F.col("l_partkey") % 250).cast("long").alias("r"), (F.col("l_orderkey") % 240).cast("long").alias("c"),
        F.col("l_quantity").cast("long").alias("q"), F.floor("l_extendedprice").cast("long").alias("e"), F.col("l_linenumber").cast("long").alias("ln"),
    ).groupBy("tile", "r", "c").agg(F.max("q").alias("q"), F.max("e").alias("e"), F.max("ln").alias("ln"))
    r, c, q, e, ln = (F.col(x) for x in ("r", "c", "q", "e", "ln"))
    v = F.when((r + c) % 37 == 0, 0).otherwise(1)
    body = {
        "B01": 120 + q * 13, "B02": 150 + q * 40, "B03": 180 + (e * 3) % 1900, "B04": 200 + e % 3000, "B05": 210 + (e * 11) % 2700, "B06": 250 + (e * 13) % 3100, "B07": 270 + (e * 17) % 3700,
        "B08": 300 + (e + 37 * q) % 5000, "B8A": 310 + (e * 19) % 4100, "B09": 90 + ln * 100, "B11": 100 + (e * 7) % 2500, "B12": 80 + (e * 5) % 2300,
    }
    kind = (F.floor(r / 6) + F.floor(c / 6) + F.when(ln >= 6, 1).otherwise(0)) % 11
    codes = F.array(*[F.lit(x) for x in (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100)])
    code = F.when(v == 0, 0).otherwise(F.get(codes, kind.cast("int")))
    out = raw.select("tile", "r", "c", centre(WEST, STEP, c).alias("lon"), centre(NORTH, -STEP, r).alias("lat"), *[(v * body[b]).cast("int").alias(b) for b in BANDS], code.alias("wc_code"))
    return out.withColumn("label", class_of(F.col("wc_code")))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored pixel table, in the order of tiles, rows and columns."""
    return store.once(spark, "pixels", sf_dir, lambda path: store.write_sorted(_pixels(spark, sf_dir), path, "tile", "r", "c"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.index_pixels(pixels(spark, sf_dir), LEVEL)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored cells of each tile, with their centres, by period and tile and in the order of ids."""
    build = lambda: ops.with_centres(ops.cell_aggregate(indexed(spark, sf_dir)), LEVEL).withColumn("period", F.lit(PERIODS[0]))
    return store.once(spark, "cells", sf_dir, lambda path: store.write_cells(build(), path))


def arm(ix, iy, a: int, b: int, below: int, shift: int):
    """A made-up prediction: right for ``below`` per cent of the cells, else another class."""
    return F.when((ix * a + iy * b) % 100 < below, F.col("label")).otherwise((F.col("label") + shift) % 8 + 1).cast("int")


def predictions(cells: DataFrame) -> DataFrame:
    """``cell_id, label`` with the three arms' predictions."""
    ix, iy = cell_xy(F.col("cell_id"), LEVEL)
    return cells.withColumns({"pred_a5": arm(ix, iy, 7919, 104729, 75, 0), "pred_a5_transfer": arm(ix, iy, 104729, 1299709, 65, 2), "pred_raster": arm(ix, iy, 15485863, 7919, 70, 4)})


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored statistics of all cells, with their centres."""
    return store.once(spark, "cell-stats", sf_dir, lambda path: store.write_sorted(ops.with_centres(ops.cell_stats(indexed(spark, sf_dir)), LEVEL), path, "cell_id"))


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored predictions of the three arms by cell."""
    build = lambda: predictions(ops.majority(indexed(spark, sf_dir), ["cell_id"], "label").select("cell_id", "label").filter("label <> 0"))
    return store.once(spark, "cell-predictions", sf_dir, lambda path: store.write_sorted(build(), path, "cell_id"))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paired table of the fixture, through the operator that joins it from its four inputs."""
    own = arms(spark, sf_dir)
    retrained, raster, transfer = own.select("cell_id", "label", F.col("pred_a5").alias("pred")), own.select("cell_id", F.col("pred_raster").alias("value")), own.select("cell_id", F.col("pred_a5_transfer").alias("pred"))
    return metrics.paired_table(retrained, raster, stats(spark, sf_dir), transfer, LEVEL)
