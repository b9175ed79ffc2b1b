"""Raster operators on pixel tables ``tile, r, c, ...``: grids and blocks are generated, neighbours are found by equi-joins on indices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.functions.geom import Ring, within
from cellmosaic.functions.mercator import to_mercator
from cellmosaic.functions.spectral import class_of


def block_grid(spark: SparkSession, height: int, width: int, size: int = 1024) -> DataFrame:
    """Windows of at most ``size`` by ``size``, clipped at the edges."""
    cols = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"), F.lit(size).cast("long")))
    edge = lambda all_, off: F.least(F.lit(size).cast("long"), F.lit(all_).cast("long") - F.col(off))
    both = spark.range(0, height, size).select(F.col("id").alias("row_off"), cols.alias("col_off"))
    return both.select("row_off", "col_off", edge(height, "row_off").alias("h"), edge(width, "col_off").alias("w"))


def centre(origin: float, step: float, index: Column) -> Column:
    """The coordinate of a pixel's centre."""
    return F.lit(origin) + (index + F.lit(0.5)) * F.lit(step)


def pixel_at(coordinate: Column, origin: float, step: float) -> Column:
    """The index of the pixel that holds a coordinate."""
    return F.floor((coordinate - F.lit(origin)) / F.lit(step)).cast("long")


def mosaic(pixels: DataFrame, value: str, nodata: int = 0) -> DataFrame:
    """Of overlapping tiles, the last one by name that has a value."""
    own = pixels.filter(F.col(value) != nodata)
    return own.groupBy("r", "c").agg(F.max_by(value, "tile").alias(value), F.max("tile").alias("tile"))


def decimate(pixels: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th pixel both ways."""
    return pixels.filter((F.col("r") % step == 0) & (F.col("c") % step == 0))


def band_stack(fine: DataFrame, coarse: DataFrame, factor: int, band: str) -> DataFrame:
    """Adds a band of ``factor`` times coarser pixels to a fine table."""
    up = coarse.select("tile", F.col("r").alias("_r"), F.col("c").alias("_c"), band)
    keyed = fine.withColumn("_r", F.floor(F.col("r") / factor)).withColumn("_c", F.floor(F.col("c") / factor))
    return keyed.join(up, ["tile", "_r", "_c"], "left").drop("_r", "_c")


def cutline(pixels: DataFrame, rings: list[Ring]) -> DataFrame:
    """Pixels whose centre lies in a polygon."""
    return pixels.filter(within(F.col("lon"), F.col("lat"), rings))


def snapped_grid(spark: SparkSession, box: tuple[float, float, float, float], x_deg: float, y_deg: float) -> DataFrame:
    """``r, c, lon, lat`` of all pixels of a grid over a box (west, south, east, north) whose edges lie at multiples of the steps, as those of all other boxes do. ``gx, gy``: the pixel's place among all."""
    west, east = math.floor(box[0] / x_deg + 1e-9), math.ceil(box[2] / x_deg - 1e-9)
    south, north = math.floor(box[1] / y_deg + 1e-9), math.ceil(box[3] / y_deg - 1e-9)
    cols = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(east - west - 1).cast("long")))
    out = spark.range(north - south).select(F.col("id").alias("r"), cols.alias("c")).withColumns({"gx": F.col("c") + west, "gy": F.lit(north - 1) - F.col("r")})
    return out.select("r", "c", "gx", "gy", ((F.col("gx") + F.lit(0.5)) * F.lit(x_deg)).alias("lon"), ((F.col("gy") + F.lit(0.5)) * F.lit(y_deg)).alias("lat"))


def warp(source: DataFrame, value: str, origin: tuple[float, float], step: tuple[float, float], box: tuple[float, float, float, float], x_deg: float, y_deg: float, nodata: int = 0, crs: str = "EPSG:3857") -> DataFrame:
    """A band in Web Mercator metres (``r, c, value``; ``origin``: its north-west corner) on a snapped grid of degrees, bilinear. Other systems are refused."""
    if crs != "EPSG:3857":
        raise ValueError(f"{crs}: the source must be EPSG:3857")
    x, y = to_mercator(F.col("lon"), F.col("lat"))
    target = snapped_grid(source.sparkSession, box, x_deg, y_deg).withColumns({"_mx": x, "_my": y})
    return reproject_bilinear(target, source, value, origin, step, nodata, "_mx", "_my").drop("_mx", "_my")


def label_raster(target: DataFrame, codes: DataFrame, origin: tuple[float, float], step: tuple[float, float], code: str = "wc_code", band: str = "B04", nodata: int = 0) -> DataFrame:
    """``target`` with ``label``: the class of the nearest land-cover code, 0 where the band has no value."""
    near = reproject_nearest(target, codes, code, origin, step)
    return near.withColumn("label", F.when(F.col(band) == nodata, 0).otherwise(class_of(F.col(code)))).drop(code)


def reproject_nearest(target: DataFrame, source: DataFrame, value: str, origin: tuple[float, float], step: tuple[float, float], x: str = "lon", y: str = "lat") -> DataFrame:
    """The value of the source pixel that holds each target pixel's centre (in columns ``x`` and ``y``, in the source's system); 0 outside. ``source``: ``r, c, value``."""
    keyed = target.withColumn("_r", pixel_at(F.col(y), origin[1], step[1])).withColumn("_c", pixel_at(F.col(x), origin[0], step[0]))
    own = source.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(value).alias("_v"))
    return keyed.join(own, ["_r", "_c"], "left").withColumn(value, F.coalesce("_v", F.lit(0))).drop("_r", "_c", "_v")


def reproject_bilinear(target: DataFrame, source: DataFrame, value: str, origin: tuple[float, float], step: tuple[float, float], nodata: int = 0, x: str = "lon", y: str = "lat") -> DataFrame:
    """Means of the four source pixels around each target centre, weighted by nearness over those with a value; rounded half up, 0 to 65,535.

    Each source pixel goes to the four squares of which it is a corner; a square is one row with its corners, so a target row joins once. ``source`` has a row a pixel at most.
    """
    spots = F.array(*[F.struct((F.col("r") - dy).alias("_r"), (F.col("c") - dx).alias("_c"), F.lit(2 * dy + dx).alias("_k")) for dy in (0, 1) for dx in (0, 1)])
    own = source.filter(F.col(value) != nodata).select(F.explode(spots).alias("_s"), F.col(value).alias("_v")).select("_s.*", "_v")
    squares = own.groupBy("_r", "_c").agg(*[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(f"_v{k}") for k in range(4)])
    at = lambda c, k: (F.col(c) - F.lit(origin[k])) / F.lit(step[k]) - F.lit(0.5)
    keyed = target.select("*", at(y, 1).alias("_y"), at(x, 0).alias("_x")).withColumns({"_r": F.floor("_y").cast("long"), "_c": F.floor("_x").cast("long")})
    fy, fx = F.col("_y") - F.col("_r"), F.col("_x") - F.col("_c")
    weights = [(1 - fy) * (1 - fx), (1 - fy) * fx, fy * (1 - fx), fy * fx]
    seen = [F.when(F.col(f"_v{k}").isNotNull(), w).otherwise(F.lit(0.0)) for k, w in enumerate(weights)]
    total = seen[0] + seen[1] + seen[2] + seen[3]
    parts = [w * F.coalesce(f"_v{k}", F.lit(0)) for k, w in enumerate(seen)]
    mean = F.when(total > 0, F.floor((parts[0] + parts[1] + parts[2] + parts[3]) / total + F.lit(0.5))).otherwise(F.lit(nodata))
    joined = keyed.join(squares, ["_r", "_c"], "left")
    return joined.select(*target.columns, F.least(F.lit(65535), F.greatest(F.lit(0), mean)).cast("int").alias(value))
