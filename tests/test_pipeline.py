"""The full run on a small project, its parts again, and the bootstrap against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic import pipeline
from cellmosaic.config import BANDS, Config
from cellmosaic.operators import benchmark, figures, validation
from cellmosaic.sources import geotiff, store

STEP = 0.0005


def brute_bootstrap(rows, n_boot, seed):
    """Draw by draw, block by block: accuracy and macro F1 by arm."""
    blocks = sorted({b for b, *_ in rows})
    drawn = np.random.default_rng(seed).integers(0, len(blocks), (n_boot, len(blocks)))
    out = {}
    for arm in sorted({a for _, a, *_ in rows}):
        values = []
        for draw in drawn:
            own = [(y, p) for k in draw for b, a, y, p, n in rows if b == blocks[k] and a == arm for _ in range(n)]
            f1 = []
            for c in {x for pair in own for x in pair}:
                tp, seen, said = sum(y == p == c for y, p in own), sum(y == c for y, _ in own), sum(p == c for _, p in own)
                f1.append(2 * tp / (seen + said))
            values.append((sum(y == p for y, p in own) / len(own), sum(f1) / len(f1)))
        out[arm] = np.quantile(np.array(values), [0.025, 0.975], axis=0)
    return out


def test_bootstrap_against_brute_force(spark):
    g = np.random.default_rng(1)
    rows = [(int(b) * 7 - 20, arm, int(y), int(p), int(n)) for b in range(9) for arm in ("pred_a5", "pred_a5_transfer", "pred_raster") for y, p, n in g.integers(1, 5, (4, 3))]
    df = spark.createDataFrame(rows, "block long, arm string, label int, pred int, n long").repartition(3, "block")
    got = {(r["arm"], r["metric"]): r for r in validation.bootstrap(df, 40, 42) if r["kind"] == "score"}
    for arm, (low, high) in brute_bootstrap(rows, 40, 42).items():
        for k, metric in enumerate(("overall_accuracy", "macro_f1")):
            assert (got[arm, metric]["low"], got[arm, metric]["high"]) == pytest.approx((low[k], high[k])), (arm, metric)
    pixels = df.filter("arm = 'pred_a5'").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("block", "label", "pred")
    alone = {r["metric"]: (r["low"], r["high"]) for r in validation.pixel_bootstrap(pixels, 40, 42)}
    assert alone["macro_f1"] == pytest.approx((got["pred_a5", "macro_f1"]["low"], got["pred_a5", "macro_f1"]["high"])) and len(alone) == 3
    assert validation.bootstrap(df.limit(0)) == []


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    """Two tiles of rasters that overlap, over several split blocks."""
    top = tmp_path_factory.mktemp("project")
    g = np.random.default_rng(3)
    for k, tile in enumerate(("T0", "T1")):
        r, c = np.mgrid[0:160, 0:200]
        kind = 1 + (r // 12 + (c + 180 * k) // 15) % 3
        bands = np.stack([500 + 300 * kind * (1 + b % 3) + g.integers(0, 60, kind.shape) for b in range(len(BANDS))]).astype("uint16")
        bands[:, :5, :5] = 0
        origin = (-0.3 + 180 * k * STEP, 51.55)
        for folder, data in (("stacks", bands), ("labels", kind[None].astype("uint8"))):
            (top / folder).mkdir(exist_ok=True)
            (top / folder / f"{tile}.tif").write_bytes(geotiff.encode(data, origin, (STEP, -STEP), block=64))
    cfg = Config(f"file://{top}/out", "test", level=15, samples_per_class=400, max_train_rows=600)
    pipeline.stage_rasters(spark, cfg, [f"{top}/stacks"], [f"{top}/labels"])
    return cfg


RINGS = [[(-0.29, 51.48), (-0.13, 51.48), (-0.13, 51.54), (-0.29, 51.54), (-0.29, 51.48)]]


def test_run(spark, project, tmp_path):
    local = Config(project.root.removeprefix("file://"), project.aoi, level=15, samples_per_class=400, max_train_rows=600)
    doc = pipeline.run(spark, local, [15], RINGS, trees=3, depth=4, n_boot=20, times=1)[15]
    scores = {r["arm"]: r for r in doc["compare"]["scores"]}
    assert set(scores) == {"pred_a5", "pred_a5_transfer", "pred_raster"} and min(r["overall_accuracy"] for r in scores.values()) > 0.6
    assert len({r["n_test"] for r in scores.values()}) == 1 and doc["pixels"]["scores"][0]["overall_accuracy"] > 0.9
    assert len(doc["bootstrap"]["intervals"]) == 18 and all(r["low"] <= r["high"] for r in doc["bootstrap"]["intervals"])
    assert set(doc["benchmark"]["queries"]) == {"point_lookup", "neighbourhood", "zonal_aoi", "group_by_class"} and doc["benchmark"]["storage_bytes"]["cells_l15"] > 0
    assert doc["table"].count("\n") == 5 and "| zonal_aoi |" in doc["table"]
    assert spark.table("cells_test_l15").count() > 0
    again = pipeline.run(spark, local, [15], RINGS, trees=3, depth=4, n_boot=20, times=1)[15]
    assert again["benchmark"] == doc["benchmark"]  # stored, not run again


def test_paired_questions_agree(spark, project):
    """On pixels and on cells: the same polygon's count of pixels, near enough."""
    own = pipeline.build_cells(spark, project, 15)
    pixels = spark.read.parquet(project.pixels())
    asked = benchmark.questions(own, pixels, RINGS, 15)
    cells_n = asked["zonal_aoi"][0]().first()["n"]
    assert cells_n > 0 and asked["zonal_aoi"][1]().first()["n"] > cells_n
    assert asked["point_lookup"][0]().count() == 1 and asked["point_lookup"][1]().count() == 1
    assert asked["neighbourhood"][0]().first()["n"] > 50 and {r["label"] for r in asked["group_by_class"][0]().collect()} >= {1, 2, 3}


def test_only_changed_tiles_are_built_again(spark, project, monkeypatch):
    first = pipeline.build_cells(spark, project, 14)
    n = {r["tile"]: r["n_pixels"] for r in first.groupBy("tile").agg(F.sum("n_pixels").alias("n_pixels")).collect()}
    written = []
    monkeypatch.setattr(store, "write_cells", lambda df, path, w=store.write_cells: written.append(sorted(r["tile"] for r in df.select("tile").distinct().collect())) or w(df, path))
    pipeline.build_cells(spark, project, 14)
    assert written == []
    path = f"{project.pixels()}/period={project.period}/tile=T1"
    part = spark.createDataFrame(spark.read.parquet(path).filter("r < 50").collect(), spark.read.parquet(path).schema)
    part.write.mode("overwrite").parquet(path)
    spark.catalog.refreshByPath(project.pixels())
    again = {r["tile"]: r["n_pixels"] for r in pipeline.build_cells(spark, project, 14).groupBy("tile").agg(F.sum("n_pixels").alias("n_pixels")).collect()}
    assert written == [["T1"]] and again["T0"] == n["T0"] and 0 < again["T1"] < n["T1"]


def test_rows_behind_figures(spark, project):
    pixels = spark.read.parquet(project.pixels())
    shares = figures.class_shares(pixels, "tile").groupBy("tile").agg(F.sum("share").alias("s"), F.count("*").alias("n")).collect()
    assert all(r["s"] == pytest.approx(1) and r["n"] == 3 for r in shares) and len(shares) == 2
    assert sum(r["share"] for r in figures.class_shares(pixels).collect()) == pytest.approx(1)
    assert figures.preview(pixels.filter("tile = 'T0'"), 160, 200, 50).agg(F.count("*"), F.max("r"), F.max("c")).first()[:] == (40 * 50, 39, 49)
    prints = spark.createDataFrame([("T1", 0.0, 0.0, 1.0, 1.0), ("T0", 5.0, 5.0, 6.0, 6.0)], "tile string, minx double, miny double, maxx double, maxy double")
    assert [(r["tile"], r["meets"]) for r in figures.study_area(prints, [[(0.5, 0.5), (2.0, 0.5), (2.0, 2.0), (0.5, 0.5)]]).collect()] == [("T0", False), ("T1", True)]
    cells_ = pipeline.build_cells(spark, project, 15).select("cell_id", "label", "lon", "lat").distinct()
    paired = cells_.withColumns({"pred_a5": F.col("label"), "pred_a5_transfer": F.col("label"), "pred_raster": F.lit(1)})
    drawn = figures.maps(paired, (-0.25, 51.5, -0.2, 51.53), 15)
    assert 0 < drawn.count() < cells_.count() and drawn.first()["outline"].startswith("POLYGON")
    assert {r["arm"]: r["f1"] for r in figures.f1_by_class(paired).filter("name = 'shrubland'").collect()} == {"pred_a5": 1.0, "pred_a5_transfer": 1.0, "pred_raster": 0.0}
