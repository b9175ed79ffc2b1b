"""Edge cases of the operators, on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic.config import BANDS
from cellmosaic.functions import geom, stats
from cellmosaic.functions.spectral import class_of, is_valid, norm_diff
from cellmosaic.operators import cells, metrics, pixels, validation
from cellmosaic.operators.grid_spec import degree_lengths_m
from cellmosaic.sources import manifest, store


def px(spark, rows):
    """Pixels (tile, label, value of every band)."""
    frame = spark.createDataFrame([(t, k, k, -0.1, 51.5, label, v) for k, (t, label, v) in enumerate(rows)], "tile string, r long, c long, lon double, lat double, label int, v int")
    return frame.withColumns({b: F.col("v") for b in BANDS})


def test_cells_nodata_ties_and_single_pixels(spark):
    own = cells.index_pixels(px(spark, [("T0", 2, 5), ("T0", 1, 7), ("T0", 1, 9), ("T0", 2, 11), ("T0", 3, 0), ("T1", 0, 4)]), 18)
    got = {r["tile"]: r for r in cells.cell_aggregate(own).collect()}
    assert (got["T0"]["n_pixels"], got["T0"]["label"], got["T0"]["B08"]) == (4, 1, 8.0)
    assert (got["T1"]["n_pixels"], got["T1"]["label"]) == (1, 0)
    one = cells.cell_stats(own.filter("tile = 'T1'")).first()
    assert (one["label_purity"], one["b08_std"]) == (1.0, 0.0)
    both = cells.cell_dedup(cells.cell_aggregate(own)).first()
    assert (both["n_pixels"], both["tile"], both["label"]) == (5, "T0", 0) and both["B08"] == pytest.approx(36 / 5)
    assert cells.raster_majority(own).first()["n_pixels"] == 4


def test_merging_one_tile_changes_nothing(spark):
    own = cells.cell_aggregate(cells.index_pixels(px(spark, [("T0", k % 3, 5 + k) for k in range(20)]), 18))
    assert cells.cell_dedup(own).select(*sorted(own.columns)).exceptAll(own.select(*sorted(own.columns))).count() == 0


def test_functions(spark):
    row = spark.range(1).select(
        norm_diff(F.lit(0), F.lit(0)).alias("zero"), norm_diff(F.lit(3), F.lit(1)).alias("half"), class_of(F.lit(70)).alias("snow"), class_of(F.lit(77)).alias("unknown"),
        stats.mcnemar(F.lit(0), F.lit(0)).alias("m0"), stats.mcnemar(F.lit(5), F.lit(5)).alias("m5"), stats.purity_band(F.lit(0.75)).alias("band"),
    ).first()
    assert tuple(row) == (0.0, 0.5, 0, 0, 0.0, pytest.approx(0.1), "0.75-1.0")
    assert stats.mcnemar_p(0) == 1 and stats.mcnemar_p(3.841459) == pytest.approx(0.05, abs=1e-6)
    assert px(spark, [("T", 1, 0), ("T", 1, 1)]).filter(is_valid()).count() == 1


def test_scores_with_a_class_that_is_only_predicted(spark):
    counts = spark.createDataFrame([(1, 1, 3), (1, 2, 1)], "label int, pred int, n long")
    out = metrics.metrics_overall(counts).first()
    assert (out["n_test"], out["overall_accuracy"]) == (4, 0.75) and out["macro_f1"] == pytest.approx((6 / 7) / 2)
    dense = np.zeros((9, 9))
    dense[1, 1], dense[1, 2] = 3, 1
    assert validation.scores(dense) == pytest.approx([0.75, 3 / 7, 6 / 7])
    assert (validation.scores(np.zeros((9, 9))) == 0).all()


def test_missing_transfer_predictions_leave_only_their_arm(spark):
    base = spark.createDataFrame([(k, 1, 1) for k in range(1, 5)], "cell_id long, label int, pred int")
    made = base.select("cell_id", F.lit(10).alias("n_pixels"), F.lit(1.0).alias("label_purity"), F.lit(0.0).alias("b08_std"), F.lit(0.0).alias("b08_mean"))
    own = metrics.paired_table(base, base.select("cell_id", F.col("pred").alias("value")), made, base.limit(2), 14)
    assert metrics.missing_transfer(own) == 2
    assert {r["arm"]: r["n"] for r in metrics.arms(own).groupBy("arm").agg(F.count("*").alias("n")).collect()} == {"pred_a5": 4, "pred_a5_transfer": 2, "pred_raster": 4}
    loss = metrics.info_loss(own).first()
    assert loss["mean_b08_cv"] is None and loss["pure_fraction"] == 1


def test_geometry():
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    assert geom.rings_from_wkt("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))") == [square]
    assert geom.rings_from_geojson('{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}}') == [square]
    assert geom.centroid(square) == (1.0, 1.0) and geom.inside((1, 1), [square]) and not geom.inside((3, 1), [square])
    assert geom.box_meets((1.5, 1.5, 3, 3), [square]) and geom.box_meets((0.5, 0.5, 0.6, 0.6), [square]) and geom.box_meets((-1, 0.5, 3, 0.6), [square]) and not geom.box_meets((3, 3, 4, 4), [square])
    assert geom.simplify([(0, 0), (1, 1e-6), (2, 0)]) == [(0, 0), (2, 0)] and len(geom.polygon_wkb(square)) == 13 + 80
    assert degree_lengths_m(0.0)[0] == pytest.approx(111319.49, abs=0.01)


def test_tiles_and_manifest(spark, tmp_path):
    assert {r["name"] for r in manifest.cover_tiles(spark, (-1.0, 51.0, 0.0, 51.0)).collect()} == {"N51W003", "N51E000"}
    (tmp_path / "m.tsv").write_text("item_id\tasset_key\tasset_href\nT1_2022-01-01_2023-01-01\tB04\thttps://x.invalid/a\nT2_2023-01-01_2024-01-01\tB04\thttps://x.invalid/b\n")
    own = manifest.parse_manifest(manifest.read_manifest(spark, str(tmp_path / "m.tsv")), "2022-01-01_2023-01-01").collect()
    assert [(r["tile"], r["period"], r["band"]) for r in own] == [("T1", "2022-01-01_2023-01-01", "B04")]


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/cells"
    own = cells.cell_aggregate(cells.index_pixels(px(spark, [("T0", 1, 5), ("T1", 1, 6)]), 18)).withColumn("period", F.lit("p"))
    store.write_cells(own, path)
    store.write_cells(own.filter("tile = 'T1'"), path)
    assert store.read_cells(spark, path, "p").count() == 2 and store.has_data(spark, path) and store.stored_bytes(spark, path) > 0
    assert store.register_views(spark, "x", {18: path, 19: path + "-none"}) == ["cells_x_l18"]
    assert store.pending(own, own.filter("tile = 'T0'"), ["tile"]).collect()[0]["tile"] == "T1"
    first = store.materialize(spark, path + "-m", lambda: spark.range(3))
    assert store.exists(spark, path + "-m") and not store.exists(spark, path + "-n")
    assert first.count() == store.materialize(spark, path + "-m", lambda: spark.range(9)).count() == 3
    store.write_json(str(tmp_path / "r" / "x.json"), {"a": 1})
    assert (tmp_path / "r" / "x.json").read_text() == '{\n  "a": 1\n}'


def test_bilinear_and_mosaic(spark):
    source = spark.createDataFrame([(0, 0, 10), (0, 1, 20), (1, 0, 0), (1, 1, 40)], "r long, c long, v int")
    target = spark.createDataFrame([(1.0, 1.0), (0.5, 0.5), (9.0, 9.0)], "lon double, lat double")
    got = {(r["lon"], r["lat"]): r["v"] for r in pixels.reproject_bilinear(target, source, "v", (0.0, 0.0), (1.0, 1.0)).collect()}
    assert got == {(1.0, 1.0): 23, (0.5, 0.5): 10, (9.0, 9.0): 0}
    own = spark.createDataFrame([("A", 0, 0, 1), ("B", 0, 0, 0), ("B", 0, 1, 2)], "tile string, r long, c long, v int")
    assert sorted(map(tuple, pixels.mosaic(own, "v").collect())) == [(0, 0, 1, "A"), (0, 1, 2, "B")]


def test_streamed_tiles_become_partitions(spark, tmp_path):
    from cellmosaic.schema import PIXELS
    from cellmosaic.streaming.ingest import ingest

    base = f"file://{tmp_path}"
    for k in (0, 1):
        px(spark, [(f"T{k}", 1, 5)]).select(*PIXELS.names).write.mode("append").parquet(f"{base}/pixels")
        assert ingest(spark, f"{base}/pixels", f"{base}/cells", f"{base}/checkpoint", 18, "p").awaitTermination(60)
        assert store.read_cells(spark, f"{base}/cells").count() == k + 1
