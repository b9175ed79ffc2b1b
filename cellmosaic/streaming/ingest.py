"""Pixel tiles as they arrive: each new batch of tiles becomes partitions of the cell dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellmosaic.operators.cells import cell_aggregate, index_pixels
from cellmosaic.schema import PIXELS
from cellmosaic.sources.store import write_cells


def ingest(spark: SparkSession, pixels: str, cells: str, checkpoint: str, level: int, period: str) -> StreamingQuery:
    """Takes what is in ``pixels`` now and wasn't taken before, and stops. A tile's files must arrive together: its partition is replaced as a whole."""

    def batch(df: DataFrame, _: int) -> None:
        write_cells(cell_aggregate(index_pixels(df, level)).withColumn("period", F.lit(period)), cells)

    return spark.readStream.schema(PIXELS).parquet(pixels).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
