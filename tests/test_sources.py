"""Rasters, remote catalogues, outlines and stored work."""

import http.server
import json
import sqlite3
import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmosaic.functions import geom, mercator
from cellmosaic.operators import pixels
from cellmosaic.operators.grid_spec import grid_spec
from cellmosaic.sources import geopackage, geotiff, manifest, remote, store


@pytest.mark.parametrize(("kind", "bands"), [("uint8", 1), ("uint16", 12), ("float32", 2)])
@pytest.mark.parametrize("big", [False, True])
def test_geotiff_round_trip(kind, bands, big):
    g = np.random.default_rng(0)
    own = (g.random((bands, 130, 201)) * 200).astype(kind)
    own[:, :64, :64] = 0  # a block that is left out
    data = geotiff.encode(own, (-0.5, 51.7), (0.002, -0.003), block=64, overviews=2, big=big)
    t = geotiff.GeoTiff(lambda at, n: data[at : at + n])
    assert (t.width, t.height, t.bands, t.epsg, t.nodata, t.origin, t.step) == (201, 130, bands, 4326, 0.0, (-0.5, 51.7), (0.002, -0.003))
    assert (t.window(0, 0, 130, 201) == own).all() and (t.window(33, 60, 70, 99) == own[:, 33:103, 60:159]).all()


def test_geotiff_strips_deflate_and_predictor():
    """A file as other writers make it: strips, deflate, horizontal differences."""
    import zlib

    own = (np.arange(7 * 10) % 23).astype("u2").reshape(7, 10)
    strips = [zlib.compress(np.diff(own[k : k + 3], axis=1, prepend=np.zeros((len(own[k : k + 3]), 1), "u2")).astype("<u2").tobytes()) for k in (0, 3, 6)]
    at, places = 8, []
    for x in strips:
        places.append(at)
        at += len(x)
    tail = struct.pack("<3I", *places) + struct.pack("<3I", *map(len, strips))
    rows = [(256, 4, 1, 10), (257, 4, 1, 7), (258, 3, 1, 16), (259, 3, 1, 8), (273, 4, 3, at), (277, 3, 1, 1), (278, 3, 1, 3), (279, 4, 3, at + 12), (317, 3, 1, 2)]
    ifd = struct.pack("<H", len(rows)) + b"".join(struct.pack("<HHII", *r) for r in rows) + struct.pack("<I", 0)
    data = struct.pack("<2sHI", b"II", 42, at + len(tail)) + b"".join(strips) + tail + ifd
    t = geotiff.GeoTiff(lambda k, n: data[k : k + n])
    assert (t.window(0, 0, 7, 10)[0] == own).all() and (t.window(2, 3, 4, 5)[0] == own[2:6, 3:8]).all()


def test_geotiff_source_and_writer(spark, tmp_path):
    own = (np.arange(2 * 90 * 70) % 251).astype("uint16").reshape(2, 90, 70)
    for k, tile in enumerate(("T0", "T1")):
        (tmp_path / f"{tile}.tif").write_bytes(geotiff.encode(own + k, (k * 0.2, 51.0), (0.001, -0.001), block=32))
    df = geotiff.read_geotiff(spark, str(tmp_path), bands=("B04", "B08"), size=40)
    assert df.rdd.getNumPartitions() == 12 and df.columns == ["tile", "r", "c", "lon", "lat", "B04", "B08"]
    got = {(r["tile"], r["r"], r["c"]): r for r in df.collect()}
    assert len(got) == 2 * 90 * 70
    r = got["T1", 33, 7]
    assert (r["B04"], r["B08"], r["lon"], r["lat"]) == (own[0, 33, 7] + 1, own[1, 33, 7] + 1, pytest.approx(0.2075), pytest.approx(51 - 0.0335))
    with pytest.raises(Exception, match="names for"):
        geotiff.read_geotiff(spark, str(tmp_path), bands=("one",))
    classes = df.select("tile", "r", "c", (F.col("B04") % 9).alias("pred")).filter("tile = 'T0'")
    out = geotiff.write_geotiff(classes, str(tmp_path / "pred"), (90, 70), ("pred",), {"T0": (0.0, 51.0)}, (0.001, -0.001), block=32, overviews=2).collect()
    back = geotiff.open_geotiff(out[0]["path"])
    assert len(out) == 1 and (back.window(0, 0, 90, 70)[0] == own[0] % 9).all() and back.dtype == np.uint8 and geotiff.readable(out[0]["path"])
    whole = (tmp_path / "pred" / "T0.tif").read_bytes()
    (tmp_path / "cut.tif").write_bytes(whole[: len(whole) - 500])
    assert not geotiff.readable(str(tmp_path / "cut.tif")) and not geotiff.readable(str(tmp_path / "none.tif"))


@pytest.fixture
def server():
    """A catalogue of two pages, and files: whole, cut off at first, missing."""
    calls: dict[str, int] = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def answer(self, body, code=200, length=None):
            self.send_response(code)
            self.send_header("Content-Length", str(len(body) if length is None else length))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert asked["collections"] == ["mosaic"] and asked["bbox"] == [-1, 50, 0, 51]
            n = asked.get("page", 0)
            items = [{"id": f"T{9 - n}_{p}", "assets": {b: {"href": f"http://x.invalid/{n}{p}{b}"} for b in ("B08", "B04", "thumb")}} for p in ("p1", "p2")]
            links = [{"rel": "next", "href": f"http://127.0.0.1:{self.server.server_port}/search", "body": {"page": n + 1}}] if n < 1 else []
            self.answer(json.dumps({"features": items, "links": links}).encode())

        def do_GET(self):
            calls[self.path] = calls.get(self.path, 0) + 1
            if "missing" in self.path:
                self.answer(b"", 404)
            elif "flaky" in self.path and calls[self.path] < 3:
                self.answer(b"abc", length=10)
            else:
                self.answer(b"0123456789")

        do_HEAD = do_GET

    found = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{found.server_port}", calls
    found.shutdown()


def test_remote(spark, tmp_path, server):
    base, calls = server
    rows = remote.search(f"{base}/search", "mosaic", (-1, 50, 0, 51), ("B04", "B08"))
    assert [(r["item_id"], r["asset_key"]) for r in rows] == [(f"T{k}_{p}", b) for k in (8, 9) for p in ("p1", "p2") for b in ("B04", "B08")]
    assert manifest.parse_manifest(remote.manifest(spark, rows), "p1").count() == 4
    assert remote.remote_sizes([f"{base}/a", f"{base}/missing", "http://127.0.0.1:1/x"]) == {f"{base}/a": 10, f"{base}/missing": -1, "http://127.0.0.1:1/x": -1}
    path = remote.download(f"{base}/flaky", str(tmp_path / "flaky"), wait=0)
    assert open(path, "rb").read() == b"0123456789" and calls["/flaky"] == 3
    assert remote.download(f"{base}/flaky", str(tmp_path / "flaky")) and calls["/flaky"] == 3  # it is there
    with pytest.raises(OSError, match="unreadable"):
        remote.download(f"{base}/a", str(tmp_path / "a"), wait=0, tries=2, check=lambda p: False)
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]
    assert remote.cover_tile(base, "missing", str(tmp_path)) is None and remote.cover_tile(base, "N51W003", str(tmp_path)).endswith("N51W003.tif")
    parsed = spark.createDataFrame([("T1", "p", "B04", "p/T1/B04.tif", f"{base}/one"), ("T1", "p", "B08", "p/T1/B08.tif", f"{base}/missing")], "tile string, period string, band string, path string, asset_href string")
    done = {r["path"]: (r["ok"], r["note"][:9]) for r in remote.download_all(parsed, str(tmp_path / "raw"), 2, wait=0, tries=1).collect()}
    assert done == {"p/T1/B04.tif": (True, ""), "p/T1/B08.tif": (False, "HTTPError")}
    found = remote.inventory(spark, parsed, str(tmp_path / "raw"))
    assert [(r["exists"], r["size_bytes"], r["remote_bytes"], r["intact"]) for r in found.collect()] == [(True, 10, 10, True), (False, 0, -1, False)]
    (tmp_path / "raw/p/T1/B04.tif").write_bytes(b"012")
    found = remote.inventory(spark, parsed, str(tmp_path / "raw"))
    assert [r["note"] for r in manifest.verify_tiles(found).collect()] == ["truncated", "missing"]
    todo = manifest.repair_list(found, ["T1"], "p", ["B04"])
    assert remote.repair(todo, str(tmp_path / "raw"), wait=0).first()["ok"] and (tmp_path / "raw/p/T1/B04.tif").read_bytes() == b"0123456789"


def test_geopackage(tmp_path):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    other = [(x + 5, y) for x, y in square]
    one = geom.polygon_wkb(square)
    multi = struct.pack("<BII", 1, 6, 2) + one + geom.polygon_wkb(other)
    path = str(tmp_path / "area.gpkg")
    with sqlite3.connect(path) as con:
        con.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
        con.execute("create table areas (code text, geom blob)")
        con.execute("insert into gpkg_geometry_columns values ('areas', 'geom')")
        for code, flags, envelope, body in (("E01a", 1, b"", one), ("W02", 3, struct.pack("<4d", 0, 7, 0, 2), multi), ("E01b", 0x11, b"", b"")):
            con.execute("insert into areas values (?, ?)", (code, struct.pack("<2sBBi", b"GP", 0, flags, 4326) + envelope + body))
    assert geopackage.layers(path) == [("areas", "geom")]
    assert geopackage.read_geopackage(path) == [square, square, other] and geopackage.read_geopackage(path, column="code", prefix="E01") == [square]
    assert geom.union_all([[square], [[(2.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 0.0)]]])[0][0] == (0.0, 0.0)
    assert len(geom.union_all([[square], [[(2.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 0.0)]]])) == 1
    u = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (2.0, 3.0), (2.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0), (0.0, 0.0)]
    assert geom.inside(geom.representative_point([u]), [u]) and not geom.inside((1.5, 2), [u])


def test_boxes_meet_like_the_test_on_the_driver(spark):
    g = np.random.default_rng(4)
    u = [[(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (2.0, 3.0), (2.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0), (0.0, 0.0)]]
    boxes = [(float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in zip(*(g.random(600) * 4 - 0.5, g.random(600) * 4 - 0.5), *(g.random(600) * 1.5, g.random(600) * 1.5), strict=True)]
    df = spark.createDataFrame(boxes, "x0 double, y0 double, x1 double, y1 double").withColumn("meets", geom.boxes_meet(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), u))
    got = df.collect()
    assert [r["meets"] for r in got] == [geom.box_meets(tuple(r)[:4], u) for r in got] and len({r["meets"] for r in got}) == 2


def test_points_in_a_long_outline(spark):
    """More edges than the expression holds, against the test on the driver."""
    angle = np.linspace(0, 2 * np.pi, 500, endpoint=False)
    away = 1 + 0.3 * np.sin(7 * angle)
    star = [[(float(a), float(b)) for a, b in zip(away * np.cos(angle), away * np.sin(angle), strict=True)]]
    g = np.random.default_rng(2)
    points = [(float(x), float(y)) for x, y in g.random((500, 2)) * 3 - 1.5]
    df = spark.createDataFrame(points, "x double, y double").select("x", "y", geom.within(F.col("x"), F.col("y"), star).alias("within"))
    assert len(star[0]) > geom.FEW_EDGES and len(df._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    assert [r["within"] for r in df.collect()] == [geom.inside(p, star) for p in points]


def test_store(spark, tmp_path):
    base = f"file://{tmp_path}"
    done = store.Manifest(spark, f"{base}/done")
    assert done.pending(["a", "b"]) == ["a", "b"]
    done.mark(["a"], signature="1")
    done.mark(["a", "b"], signature="2")
    assert done.done() == {"a", "b"} and done.pending(["a", "b", "c"], signature="2") == ["c"] and done.done(signature="1") == set()
    table = store.checkpoint(spark, f"{base}/t.parquet", lambda: spark.range(3))
    assert table.count() == store.checkpoint(spark, f"{base}/t.parquet", lambda: spark.range(9)).count() == 3
    assert store.checkpoint(spark, f"{base}/t.parquet", lambda: spark.range(9), force=True).count() == 9
    with pytest.raises(ValueError, match="wrote nothing"):
        store.checkpoint(spark, f"{base}/none.parquet", lambda: spark.range(0))
    assert not store.exists(spark, f"{base}/none.parquet")
    assert store.checkpoint(spark, str(tmp_path / "d.json"), lambda: {"a": 1}) == store.checkpoint(spark, str(tmp_path / "d.json"), lambda: {"a": 2}) == {"a": 1}
    (tmp_path / "a.geojson").write_text('{"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}')
    assert len(store.load(spark, str(tmp_path / "a.geojson"))[0]) == 4
    for name in ("x.shp", "x"):
        with pytest.raises(ValueError):
            store.load(spark, name)
    before = store.signature(spark, f"{base}/t.parquet")
    assert before == store.signature(spark, f"{base}/t.parquet")
    spark.range(4).write.mode("overwrite").parquet(f"{base}/t.parquet")
    assert before != store.signature(spark, f"{base}/t.parquet")


def test_warp_from_mercator(spark):
    """A plane in metres, seen on a snapped grid of degrees, is the same plane."""
    x0, y0 = mercator.point_to_mercator(-0.2, 51.6)
    step = 40.0
    source = spark.range(60 * 50).select((F.col("id") / 50).cast("long").alias("r"), (F.col("id") % 50).alias("c")).withColumn("v", (1000 + 3 * F.col("r") + 5 * F.col("c")).cast("int"))
    box = mercator.box_from_mercator((x0, y0 - 60 * step, x0 + 50 * step, y0))
    assert box[0] == pytest.approx(-0.2) and box[3] == pytest.approx(51.6)
    spec = grid_spec("a", 51.6, step)
    out = pixels.warp(source, "v", (x0, y0), (step, -step), box, spec["x_deg"], spec["y_deg"]).collect()
    inner = 0
    for r in out:
        x, y = mercator.point_to_mercator(r["lon"], r["lat"])
        c, d = (x - x0) / step - 0.5, (y0 - y) / step - 0.5
        assert r["lon"] / spec["x_deg"] - 0.5 == pytest.approx(r["gx"], abs=1e-6) and r["lat"] / spec["y_deg"] - 0.5 == pytest.approx(r["gy"], abs=1e-6)
        if 0 <= c <= 49 and 0 <= d <= 59:
            inner += 1
            assert abs(r["v"] - (1000 + 3 * d + 5 * c)) <= 0.5001
    assert inner > 2000
    there = spark.createDataFrame([(-0.13, 51.5)], "lon double, lat double")
    x, y = mercator.to_mercator(F.col("lon"), F.col("lat"))
    lon, lat = mercator.from_mercator(F.col("x"), F.col("y"))
    row = there.select(x.alias("x"), y.alias("y")).select("x", "y", lon.alias("lon"), lat.alias("lat")).first()
    assert (row["x"], row["y"]) == pytest.approx(mercator.point_to_mercator(-0.13, 51.5)) and (row["lon"], row["lat"]) == pytest.approx((-0.13, 51.5))
    for call in (lambda: pixels.warp(source, "v", (0, 0), (1, -1), box, 1, 1, crs="EPSG:27700"), lambda: grid_spec("a", 51.0, 10.0, source_crs="EPSG:27700")):
        with pytest.raises(ValueError, match="EPSG:3857"):
            call()


def test_labels_of_invalid_pixels(spark):
    target = spark.createDataFrame([(0.5, -0.5, 7), (0.5, -1.5, 0), (9.0, 9.0, 5)], "lon double, lat double, B04 int")
    codes = spark.createDataFrame([(0, 0, 10), (1, 0, 10)], "r long, c long, wc_code int")
    assert {(r["lat"], r["label"]) for r in pixels.label_raster(target, codes, (0.0, 0.0), (1.0, -1.0)).collect()} == {(-0.5, 1), (-1.5, 0), (9.0, 0)}
