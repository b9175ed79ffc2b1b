"""Datasets at rest: partitioned, sorted by cell, written once and reused."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROW_GROUP_BYTES = 64 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share. Only a local master may do without one: there a temporary folder takes its place."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cellmosaic-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cellmosaic/{name}-{uuid.uuid4().hex}"


def write_cells(cells: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Cells by period and tile, each file sorted by cell id so that its row groups prune; existing partitions are replaced one by one."""
    (
        cells.repartition("period", "tile", F.shiftright("cell_id", 40)).sortWithinPartitions("period", "tile", "cell_id")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").option("parquet.block.size", row_group_bytes).partitionBy("period", "tile").parquet(path)
    )


def write_sorted(df: DataFrame, path: str, *keys: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """A table whose files hold ranges of ``keys``, in order, so that a look-up by key reads few row groups."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", row_group_bytes).parquet(path)


_stored: dict[tuple[str, ...], tuple[str, DataFrame]] = {}


def once(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> DataFrame:
    """The table ``name`` made from the data at ``source``: written to the shared folder by this application's first call, read from there by all."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _stored or not has_data(spark, _stored[key][0]):
        path = scratch(spark, name)
        write(path)
        _stored[key] = path, spark.read.parquet(path)
    return _stored[key][1]


def read_cells(spark: SparkSession, path: str, period: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("period") == period) if period else df


def read_tiles(spark: SparkSession, path: str, period: str, tiles: list[str]) -> DataFrame:
    """The cells of some tiles, from a list of their folders alone: no other one is listed."""
    return spark.read.option("basePath", path).parquet(*[f"{path}/period={period}/tile={t}" for t in tiles])


def stored_path(df: DataFrame) -> str:
    """The folder that a stored table was read from."""
    return df.inputFiles()[0].split("/period=")[0].rsplit("/part-", 1)[0]


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that isn't done yet."""
    return wanted.select(*keys).distinct().join(done.select(*keys).distinct(), keys, "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a dataset was written to the end."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small document in any store that Spark writes to, whole or not at all."""
    jvm = spark.sparkContext._jvm
    where, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    if not fs.rename(part, where):
        raise OSError(f"{path}: not written")


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a path holds any file or partition that was committed. Replacing partitions one by one leaves no mark of success."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(where) and any(not x.getPath().getName().startswith(("_", ".")) for x in fs.listStatus(where))


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The dataset at a path, built first if it isn't there or ``force`` is set."""
    if force or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def register_views(spark: SparkSession, aoi: str, levels: dict[int, str]) -> list[str]:
    """A temporary view for each level whose cells are there."""
    names = []
    for level, path in levels.items():
        if has_data(spark, path):
            spark.read.parquet(path).createOrReplaceTempView(f"cells_{aoi}_l{level}")
            names.append(f"cells_{aoi}_l{level}")
    return names


def signature(spark: SparkSession, *paths: str) -> str:
    """What tells whether sources have changed: names, lengths and times of all files below them."""
    conf, found = spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(conf).listFiles(where, True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith((".", "_")):
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


class Manifest:
    """Work that is done: an append-only table of ``key, ts, info`` in JSON lines, a small file a call."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """The last row of each key."""
        kind = "key string, ts double, info map<string, string>"
        if not has_data(self.spark, self.path):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).json(self.path).groupBy("key").agg(F.max(F.struct("ts", F.to_json("info"))).alias("r")).select("key", "r.ts", F.from_json("r.col2", "map<string, string>").alias("info"))

    def mark(self, keys: list[str], **info) -> None:
        made = {k: str(v) for k, v in info.items()}
        self.spark.createDataFrame([(k, time.time(), made) for k in keys], "key string, ts double, info map<string, string>").coalesce(1).write.mode("append").json(self.path)

    def done(self, **info) -> set[str]:
        """Keys whose last row has this info."""
        return {r["key"] for r in self.rows().collect() if all((r["info"] or {}).get(k) == str(v) for k, v in info.items())}

    def pending(self, keys: list[str], **info) -> list[str]:
        done = self.done(**info)
        return [k for k in keys if k not in done]


def load(spark: SparkSession, path: str):
    """What is stored at a path, by its suffix: a table, rings, a document or a model."""
    from pyspark.ml import PipelineModel

    from cellmosaic.functions.geom import rings_from_geojson
    from cellmosaic.sources.geopackage import read_geopackage

    kinds = {
        ".parquet": lambda: spark.read.parquet(path), ".geojson": lambda: rings_from_geojson(get_text(spark, path)), ".gpkg": lambda: read_geopackage(path),
        ".json": lambda: json.loads(get_text(spark, path)), ".model": lambda: PipelineModel.load(path),
    }
    suffix = os.path.splitext(path.rstrip("/"))[1]
    if suffix not in kinds:
        raise ValueError(f"{path}: no loader for {suffix or 'a name without suffix'}")
    return kinds[suffix]()


def checkpoint(spark: SparkSession, path: str, build: Callable, force: bool = False):
    """What ``build`` gives, stored at a path by its suffix and loaded from there; built only if it isn't there or ``force`` is set. Empty tables are refused."""
    suffix = os.path.splitext(path.rstrip("/"))[1]
    if suffix in (".parquet", ".model"):
        if force or not (exists(spark, path) if suffix == ".parquet" else has_data(spark, path)):
            made = build()
            if suffix == ".model":
                made.write().overwrite().save(path)
            else:
                made.write.mode("overwrite").parquet(path)
                if spark.read.parquet(path).isEmpty():
                    remove(spark, path)
                    raise ValueError(f"{path}: the build wrote nothing")
    elif suffix == ".json":
        if force or not has_data(spark, path):
            put_text(spark, path, json.dumps(build(), indent=2, default=str))
    else:
        raise ValueError(f"{path}: no writer for {suffix or 'a name without suffix'}")
    return load(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_json(path: str, value: dict) -> None:
    """A small result document on the driver, whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".part", "w") as f:
        json.dump(value, f, indent=2, default=str)
    os.replace(path + ".part", path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a path, from file listings alone."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
