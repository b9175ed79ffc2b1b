"""The folder that the driver and all executors share, and tables written there to cut lineage.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset and the master is local (tests, one machine)
a temporary folder takes its place: elsewhere each machine would have its own. Tables stay until ``clear`` removes them: a lazy result may still
read them, so nothing here guesses when they are no longer needed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder."""
    found = spark.sparkContext.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cellmosaic-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    path = f"{shared_dir(spark)}/cellmosaic/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[list[str]]:
    """Gives the list of the paths that are made inside."""
    global _made
    outer, _made = _made, []
    try:
        yield _made
    finally:
        outer += _made
        _made = outer


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables and files. Only call it once every result that reads them is stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Removes all that this process has written so far."""
    remove(spark, _made)
    _made.clear()
