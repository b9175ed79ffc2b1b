"""Asset manifests, tile inventories and footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.functions.geom import Ring, bounds, boxes_meet
from cellmosaic.schema import MANIFEST

ITEM = r"^([^_]+)_(.+)$"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A TSV manifest with a header."""
    return spark.read.csv(path, sep="\t", header=True, schema=MANIFEST)


def parse_manifest(manifest: DataFrame, period: str | None = None) -> DataFrame:
    """``tile, period, band, path, asset_href``, in the order of items and bands; items of one period if given."""
    own = manifest.filter(F.col("item_id").endswith("_" + period)) if period else manifest
    tile, when = F.regexp_extract("item_id", ITEM, 1), F.regexp_extract("item_id", ITEM, 2)
    path = F.concat_ws("/", when, tile, F.concat("asset_key", F.lit(".tif")))
    return own.orderBy("item_id", "asset_key").select(tile.alias("tile"), when.alias("period"), F.col("asset_key").alias("band"), path.alias("path"), "asset_href")


def verify_tiles(inventory: DataFrame, error: str | None = None) -> DataFrame:
    """Adds ``ok`` and ``note``: missing, truncated (smaller than the remote file), error (unreadable), or empty. A remote size of -1 is unknown."""
    note = (
        F.when(~F.col("exists"), "missing").when((F.col("remote_bytes") >= 0) & (F.col("size_bytes") < F.col("remote_bytes")), "truncated")
        .when(~F.col("intact"), error or "error").otherwise("")
    )
    return inventory.withColumn("note", note).withColumn("ok", F.col("note") == "")


def repair_list(inventory: DataFrame, tiles: list[str], period: str, bands: list[str]) -> DataFrame:
    """Files of the given tiles, period and bands that need another download."""
    return inventory.filter(F.col("tile").isin(*tiles) & (F.col("period") == period) & F.col("band").isin(*bands) & ~F.col("intact"))


def footprints(pixels: DataFrame, half: float) -> DataFrame:
    """Each tile's box from its pixels' centres."""
    return pixels.groupBy("tile").agg((F.min("lon") - half).alias("minx"), (F.min("lat") - half).alias("miny"), (F.max("lon") + half).alias("maxx"), (F.max("lat") + half).alias("maxy"))


def tiles_for_aoi(prints: DataFrame, rings: list[Ring]) -> DataFrame:
    """Tiles whose box meets the polygon, sorted. Boxes are compared first, as a range that a scan can prune by."""
    x0, y0, x1, y1 = bounds(rings)
    near = prints.filter((F.col("minx") <= x1) & (F.col("maxx") >= x0) & (F.col("miny") <= y1) & (F.col("maxy") >= y0))
    return near.filter(boxes_meet(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), rings)).select("tile").distinct().orderBy("tile")


def cover_tiles(spark: SparkSession, box: tuple[float, float, float, float], step: int = 3) -> DataFrame:
    """Names like N51W003 of the land-cover tiles over a box: south-west corners every ``step`` degrees."""
    span = lambda lo, hi: F.sequence(F.floor(F.lit(lo) / step) * step, F.floor(F.lit(hi) / step) * step, F.lit(step).cast("long"))
    grid = spark.range(1).select(F.explode(span(box[1], box[3])).alias("lat")).select("lat", F.explode(span(box[0], box[2])).alias("lon"))
    part = lambda c, plus, minus, n: F.concat(F.when(F.col(c) >= 0, plus).otherwise(minus), F.lpad(F.abs(c).cast("string"), n, "0"))
    return grid.select("lat", "lon", F.concat(part("lat", "N", "S", 2), part("lon", "E", "W", 3)).alias("name"))


def prefix_filter(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose code begins with a prefix; pushed down to the scan."""
    return df.filter(F.col(column).startswith(prefix))
