"""A session with the settings that the engine is meant for."""

from __future__ import annotations

import os
import sys
import tempfile

from pyspark.sql import SparkSession


def session(name: str = "cellmosaic", master: str | None = None, memory: str | None = None, temp: str | None = None, shared: str | None = None, **conf: str) -> SparkSession:
    """``memory``: of the driver, or ``CELLMOSAIC_MEMORY``, or 4g; ``temp``: where spills go, or ``CELLMOSAIC_TEMP``; ``shared``: the folder that all executors share. ``conf``: more settings, with ``__`` for dots."""
    temp = temp or os.environ.get("CELLMOSAIC_TEMP")
    builder = (
        SparkSession.builder.appName(name).config("spark.driver.memory", memory or os.environ.get("CELLMOSAIC_MEMORY", "4g")).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.parquet.compression.codec", "zstd").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    if master:
        builder = builder.master(master)
    if temp:
        builder = builder.config("spark.local.dir", temp)
    if shared or (master or "").startswith("local["):
        builder = builder.config("spark.checkpoint.dir", shared or "file://" + tempfile.mkdtemp(prefix="cellmosaic-"))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
