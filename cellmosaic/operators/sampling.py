"""Stratified samples and caps, in an order by hashes that any engine repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.operators.cells import with_centres
from cellmosaic.operators.metrics import with_split


def top_by_group(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group. Spark keeps only ``n`` rows a group and task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def sample_cells(cells: DataFrame, per_class: int = 5000, exclude: tuple[int, ...] = (), level: int | None = None, seed: int = 42) -> DataFrame:
    """At most ``per_class`` cells of each tile and label. With ``level``, also ``lon, lat`` (unless stored), ``block``, ``test`` and ``level``, for the sampled rows only."""
    own = cells.filter("label <> 0")
    if exclude:
        own = own.filter(~F.col("label").isin(*exclude))
    out = top_by_group(own, ["tile", "label"], [F.md5(F.col("cell_id").cast("string")), F.col("cell_id")], per_class)
    if level is None:
        return out
    return with_split(out if "lon" in cells.columns else with_centres(out, level), seed).withColumn("level", F.lit(level))


def sample_pixels(pixels: DataFrame, per_class: int = 5000, seed: int = 42) -> DataFrame:
    """At most ``per_class`` pixels of each tile and label."""
    name = F.concat(F.lit(f"{seed}:"), "tile", F.lit(":"), F.col("r").cast("string"), F.lit(":"), F.col("c").cast("string"))
    return top_by_group(pixels.filter("label <> 0"), ["tile", "label"], [F.md5(name), F.col("r"), F.col("c")], per_class)


def train_cap(rows: DataFrame, n: int = 50_000) -> DataFrame:
    """At most ``n`` rows by hash of the cell; a top-k, without a full sort."""
    return rows.orderBy(F.md5(F.col("cell_id").cast("string")), "cell_id").limit(n)
