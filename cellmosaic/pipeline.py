"""The full run of one project: pixels to samples, forests, cells, predictions on both, comparison, bootstrap and benchmark.

``python -m cellmosaic.pipeline --root ROOT --aoi NAME --levels 18 17 --outline FILE``

A project's folder holds ``pixels`` (Parquet: ``period, tile, r, c, lon, lat``, bands, ``label``), which ``stage_rasters`` makes from GeoTIFFs. Everything else is built from it once, stored by its
name below the folder, and read from there; a second run builds only what is missing. Cells are built by tile: a tile whose pixels have changed since is built again.
"""

from __future__ import annotations

import argparse
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.config import BANDS, Config
from cellmosaic.functions.geom import Ring, bounds
from cellmosaic.functions.stats import mcnemar_p
from cellmosaic.operators import benchmark, cells, metrics, model, sampling, validation
from cellmosaic.sources import geotiff, store


def stage_rasters(spark: SparkSession, cfg: Config, stacks: Iterable[str], labels: Iterable[str], period: str | None = None) -> None:
    """Pixel tables of tiles from pairs of GeoTIFFs of one grid: twelve bands, and classes. Pixels without any reflectance have class 0."""
    bands = geotiff.read_geotiff(spark, *stacks, bands=BANDS)
    classes = geotiff.read_geotiff(spark, *labels, bands=("label",)).select("tile", "r", "c", "label")
    own = bands.join(classes, ["tile", "r", "c"]).withColumn("label", F.when(cells.is_valid(), F.col("label")).otherwise(0)).withColumn("period", F.lit(period or cfg.period))
    own.repartition("period", "tile").sortWithinPartitions("period", "tile", "r", "c").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "tile").parquet(cfg.pixels())


def build_cells(spark: SparkSession, cfg: Config, level: int) -> DataFrame:
    """The cells of all tiles of the period: those that are missing, or whose pixels have changed, are built in one job, the others stay."""
    pixels, done = spark.read.parquet(cfg.pixels()).filter(F.col("period") == cfg.period), store.Manifest(spark, f"{cfg.manifests()}/cells-l{level}")
    tiles = sorted(r["tile"] for r in pixels.select("tile").distinct().collect())
    if not tiles:
        raise ValueError(f"{cfg.pixels()}: no pixels of {cfg.period}")
    signs = {t: store.signature(spark, f"{cfg.pixels()}/period={cfg.period}/tile={t}") for t in tiles}
    known = {r["key"]: (r["info"] or {}).get("signature") for r in done.rows().collect()}
    todo = [t for t in tiles if known.get(f"{cfg.period}/{t}") != signs[t]]
    if todo:
        own = cells.cell_aggregate(cells.index_pixels(pixels.filter(F.col("tile").isin(todo)), level))
        store.write_cells(cells.with_centres(own, level).withColumn("period", F.lit(cfg.period)), cfg.cells(level))
        for t in todo:
            done.mark([f"{cfg.period}/{t}"], signature=signs[t])
    return store.read_cells(spark, cfg.cells(level), cfg.period)


def document(rows: DataFrame) -> list[dict]:
    """Few rows as dictionaries."""
    return [r.asDict(recursive=True) for r in rows.collect()]


def compare(paired: DataFrame, seed: int = 42, strict: bool = True) -> dict:
    """Scores of the three arms on test cells, their tests against the raster's, and what one value a cell hides, over all cells. ``strict``: each test cell needs a transferred prediction."""
    split = metrics.with_split(paired, seed)
    test = split.filter("test")
    if strict and (n := metrics.missing_transfer(test)):
        raise ValueError(f"{n} test cells without a transferred prediction")
    counts = metrics.confusion(metrics.arms(test), "arm")
    tests = {}
    for arm in metrics.ARMS[:-1]:
        r = metrics.mcnemar_counts(test, arm).first()
        tests[arm] = {"b": r["b"], "c": r["c"], "statistic": r["statistic"], "p_value": mcnemar_p(r["statistic"])}
    return {
        "scores": document(metrics.metrics_overall(counts, "arm")), "per_class": document(metrics.metrics_per_class(counts, "arm")), "mcnemar": tests,
        "info_loss": document(metrics.info_loss(split))[0], "mixed_by_class": document(metrics.mixed_by_class(split)), "accuracy_by_purity": document(metrics.accuracy_by_purity(test)),
    }


def run(spark: SparkSession, cfg: Config, levels: Iterable[int], rings: list[Ring], trees: int = 200, depth: int = 30, n_boot: int = 1000, times: int = 3, force: bool = False) -> dict[int, dict]:
    """All stages; the result documents by level, which also lie in the project's results."""
    path = lambda kind, name: f"{cfg.path(kind)}/{cfg.period}-{name}"
    kept = lambda kind, name, build: store.checkpoint(spark, path(kind, name), build, force)
    pixels = spark.read.parquet(cfg.pixels()).filter(F.col("period") == cfg.period)
    split = lambda df: metrics.with_split(df, cfg.seed)

    sample = kept("samples", "pixels.parquet", lambda: split(sampling.sample_pixels(pixels, cfg.samples_per_class, cfg.seed)))
    forest = kept("models", "pixels.model", lambda: model.train(sample.filter("not test"), trees, cfg.seed, depth))
    tested = model.predict(forest, sample.filter("test"))
    counts = metrics.confusion(tested.withColumn("arm", F.lit("pixels")), "arm")
    raster_doc = kept("results", "pixels.json", lambda: {"scores": document(metrics.metrics_overall(counts, "arm")), "per_class": document(metrics.metrics_per_class(counts, "arm")), "bootstrap": validation.pixel_bootstrap(tested, n_boot, cfg.seed)})
    predicted = kept("predictions", "pixels.parquet", lambda: model.predict(forest, pixels.filter(cells.is_valid())).select("tile", "r", "c", "lon", "lat", *BANDS, F.col("pred").alias("value")))

    out: dict[int, dict] = {}
    for level in levels:
        own = build_cells(spark, cfg, level)
        merged = kept("cells-merged", f"l{level}.parquet", lambda own=own: cells.cell_dedup(own))
        train = kept("samples", f"cells-l{level}.parquet", lambda own=own, level=level: sampling.sample_cells(own, cfg.samples_per_class, cfg.exclude_classes, level, cfg.seed))
        of_cells = kept("models", f"cells-l{level}.model", lambda train=train: model.train(sampling.train_cap(train.filter("not test"), cfg.max_train_rows), trees, cfg.seed, depth))
        labelled = merged.filter("label <> 0")
        pred = lambda m, labelled=labelled: model.predict(m, labelled).select("cell_id", "label", "pred")
        retrained = kept("predictions", f"cells-l{level}.parquet", lambda of_cells=of_cells, pred=pred: pred(of_cells))
        transfer = kept("predictions", f"transfer-l{level}.parquet", lambda pred=pred: pred(forest))
        raster = kept("predictions", f"raster-l{level}.parquet", lambda level=level: cells.raster_majority(cells.index_pixels(predicted, level), "value"))
        stats = kept("stats", f"l{level}.parquet", lambda level=level: cells.with_centres(cells.cell_stats(cells.index_pixels(pixels, level)), level))
        paired = metrics.paired_table(retrained, raster, stats, transfer, level, cfg.exclude_classes)
        test = split(paired).filter("test")
        doc = kept("results", f"compare-l{level}.json", lambda paired=paired, level=level: {"level": level, **compare(paired, cfg.seed)})
        boot = kept("results", f"bootstrap-l{level}.json", lambda test=test: {"seed": cfg.seed, "n_boot": n_boot, "intervals": validation.bootstrap(validation.block_confusion(test), n_boot, cfg.seed)})
        audit = kept("results", f"audit-l{level}.json", lambda test=test: {"high_purity": document(metrics.audit_high_purity(test))[0], "samples": document(metrics.audit_samples(test))})
        stored = {"pixels": cfg.pixels(), f"cells_l{level}": cfg.cells(level)}
        timed = kept("results", f"benchmark-l{level}.json", lambda own=own, level=level, stored=stored: benchmark.run(spark, own, pixels, rings, level, stored, times))
        out[level] = {"pixels": raster_doc, "compare": doc, "bootstrap": boot, "audit": audit, "benchmark": timed, "table": benchmark.table(timed)}
    store.register_views(spark, cfg.aoi, {level: cfg.cells(level) for level in levels})
    return out


def main(args: list[str] | None = None) -> None:
    from cellmosaic.session import session

    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--root", required=True)
    p.add_argument("--aoi", default="london")
    p.add_argument("--levels", type=int, nargs="+", default=[18])
    p.add_argument("--outline", help="GeoJSON or GeoPackage of the area; by default the pixels' box")
    p.add_argument("--trees", type=int, default=200)
    p.add_argument("--depth", type=int, default=30)
    p.add_argument("--force", action="store_true")
    given = p.parse_args(args)
    spark, cfg = session(), Config(given.root, given.aoi)
    if given.outline:
        rings = store.load(spark, given.outline)
    else:
        x0, y0, x1, y1 = spark.read.parquet(cfg.pixels()).agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
        rings = [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]
    assert bounds(rings)
    for level, doc in run(spark, cfg, given.levels, rings, given.trees, given.depth, force=given.force).items():
        print(f"level {level}\n{doc['table']}")


if __name__ == "__main__":
    main()
