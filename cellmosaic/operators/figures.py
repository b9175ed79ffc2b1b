"""The rows behind a project's figures. Drawing is left to others; each frame is small enough to be collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.functions.geom import Ring, boxes_meet, within_box
from cellmosaic.functions.grid import cell_ring, ring_wkt
from cellmosaic.functions.spectral import class_name
from cellmosaic.functions.stats import ratio
from cellmosaic.operators import metrics


def study_area(prints: DataFrame, rings: list[Ring]) -> DataFrame:
    """All footprints, and whether each meets the area."""
    return prints.withColumn("meets", boxes_meet(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), rings)).orderBy("tile")


def preview(pixels: DataFrame, height: int, width: int, most: int = 1400) -> DataFrame:
    """Every k-th pixel both ways, so that no side has more than ``most``; ``r`` and ``c`` count the pixels taken."""
    k = max(1, -(-max(height, width) // most))
    return pixels.filter((F.col("r") % k == 0) & (F.col("c") % k == 0)).withColumns({"r": F.floor(F.col("r") / k), "c": F.floor(F.col("c") / k)})


def class_shares(rows: DataFrame, *keys: str) -> DataFrame:
    """Each class's share of the rows that have one, by name."""
    counts = rows.filter("label <> 0").groupBy(*keys, "label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))  # over nine rows a key at most
    return counts.select(*keys, class_name(F.col("label")).alias("name"), "n", ratio(F.col("n"), total).alias("share"))


def f1_by_class(paired: DataFrame) -> DataFrame:
    """F1 of each class and arm on test cells."""
    counts = metrics.confusion(metrics.arms(metrics.with_split(paired).filter("test")), "arm")
    return metrics.metrics_per_class(counts, "arm").select("arm", class_name(F.col("class")).alias("name"), "f1", "support")


def maps(paired: DataFrame, box: tuple[float, float, float, float], level: int) -> DataFrame:
    """Outlines, classes and predictions of the cells whose centre lies in a box, and where raster and cells agree."""
    own = paired.filter(within_box(F.col("lon"), F.col("lat"), box))
    return own.select("cell_id", "label", *metrics.ARMS, (F.col("pred_raster") == F.col("pred_a5")).alias("agree"), ring_wkt(cell_ring(F.col("cell_id"), level)).alias("outline"))
