"""The registry of queries over the fixture, each with SQL that gives the same rows.

Doubles are rounded to six places where they are sums or quotients; floats are float means of integers and equal as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.config import BANDS, INDICES, PERIODS
from cellmosaic.functions import grid
from cellmosaic.functions.geom import bounds, within, within_box
from cellmosaic.functions.spectral import class_name, indices, is_valid
from cellmosaic.operators import cells, metrics, model, pixels, sampling, validation
from cellmosaic.operators.grid_spec import grid_spec
from cellmosaic.plans import fixtures as fx
from cellmosaic.plans.fixture_sql import CELL, PAIRED, PX
from cellmosaic.sources import manifest, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
L = fx.LEVEL
POLYGON = [[(-0.45, 51.25), (-0.1, 51.3), (-0.05, 51.6), (-0.3, 51.68), (-0.42, 51.5), (-0.45, 51.25)]]
BOX = (-0.35, 51.4, -0.25, 51.5)
SPOT = (-0.2471, 51.4551)  # has a pixel at every scale


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


_N = "cast(count(*) AS bigint)"
_MEANS = ", ".join(f"cast(avg({b}) AS float) AS {b}" for b in BANDS)
_BANDS = ", ".join(BANDS)
_XY = "cast({v} AS bigint)"
_ENCODE = """
m1 AS (SELECT *, (ix >> 13) * 6 + (iy >> 13) AS face, ((ix & 8191) | ((ix & 8191) << 16)) & 281470681808895 AS a1, ((iy & 8191) | ((iy & 8191) << 16)) & 281470681808895 AS b1 FROM ij),
m2 AS (SELECT *, (a1 | (a1 << 8)) & 71777214294589695 AS a2, (b1 | (b1 << 8)) & 71777214294589695 AS b2 FROM m1),
m3 AS (SELECT *, (a2 | (a2 << 4)) & 1085102592571150095 AS a3, (b2 | (b2 << 4)) & 1085102592571150095 AS b3 FROM m2),
m4 AS (SELECT *, (a3 | (a3 << 2)) & 3689348814741910323 AS a4, (b3 | (b3 << 2)) & 3689348814741910323 AS b4 FROM m3),
m5 AS (SELECT *, (a4 | (a4 << 1)) & 6148914691236517205 AS a5, (b4 | (b4 << 1)) & 6148914691236517205 AS b5 FROM m4),
ids AS (SELECT *, ((((face << 26) | a5 | (b5 << 1)) << 1) | 1) << 24 AS cell_id FROM m5)
"""
_SPOT_XY = f"cast(floor(({SPOT[0]}::double + 180) / 360 * 81920) AS bigint) AS x0, cast(floor((sin(radians({SPOT[1]}::double)) + 1) / 2 * 49152) AS bigint) AS y0"
_DISK = f"""
WITH s AS (SELECT {_SPOT_XY}),
ij AS (SELECT x0 + dx AS ix, y0 + dy AS iy FROM s, (SELECT unnest(generate_series(-8, 8)) AS dx), (SELECT unnest(generate_series(-8, 8)) AS dy) WHERE abs(dx) + abs(dy) <= 8),
{_ENCODE}"""
# majority: the lowest label of the most frequent ones
_MAJ = """
, lc AS (SELECT {keys}, label, count(*) AS n FROM cell GROUP BY ALL),
lr AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, label) AS rn FROM lc),
maj AS (SELECT {keys}, label FROM lr WHERE rn = 1)"""
_AGG = PX + CELL + _MAJ.format(keys="tile, cell_id") + f"""
, agg AS (SELECT tile, cell_id, {_N} AS n_pixels, {_MEANS} FROM cell GROUP BY tile, cell_id),
ca AS (SELECT tile, cell_id, n_pixels, {_BANDS}, label FROM agg JOIN maj USING (tile, cell_id))"""
_WEIGHTED = ", ".join(f"cast(sum(cast({b} * cast(n_pixels AS float) AS float)) / sum(n_pixels) AS float) AS {b}" for b in BANDS)
_DEDUP = _AGG + f"""
, dl AS (SELECT cell_id, label, count(*) AS n FROM ca GROUP BY ALL),
dr AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, label) AS rn FROM dl),
dt AS (SELECT cell_id, tile, row_number() OVER (PARTITION BY cell_id ORDER BY n_pixels DESC, tile DESC) AS rn FROM ca),
dm AS (SELECT cell_id, cast(sum(n_pixels) AS bigint) AS n_pixels, {_WEIGHTED} FROM ca GROUP BY cell_id),
dd AS (SELECT dm.*, dr.label, dt.tile FROM dm JOIN dr ON dr.cell_id = dm.cell_id AND dr.rn = 1 JOIN dt ON dt.cell_id = dm.cell_id AND dt.rn = 1)"""
_STATS = PX + CELL + """
, pn AS (SELECT cell_id, label, count(*) AS n, sum(B08) AS x, sum(cast(B08 AS bigint) * B08) AS xx FROM cell GROUP BY ALL),
st AS (SELECT cell_id, cast(sum(n) AS bigint) AS n_pixels, max(n) / cast(sum(n) AS double) AS label_purity,
  sqrt(cast(sum(n) * sum(xx) - sum(x) * sum(x) AS double)) / sum(n) AS b08_std, sum(x) / cast(sum(n) AS double) AS b08_mean FROM pn GROUP BY cell_id)"""
_BLOCK = "cast(floor(lon / cast(0.05 AS double)) * 100000 + floor(lat / cast(0.05 AS double)) AS bigint)"
_TEST = "('0x' || substr(md5('42:' || cast(block AS string)), 1, 8))::bigint % 1000 < 250"
_SPLIT = PX + CELL + PAIRED + f"""
, pb AS (SELECT *, {_BLOCK} AS block FROM paired),
ps AS (SELECT *, {_TEST} AS test FROM pb),
arms AS (SELECT block, test, label, 'pred_a5' AS arm, pred_a5 AS pred FROM ps UNION ALL SELECT block, test, label, 'pred_a5_transfer', pred_a5_transfer FROM ps
  UNION ALL SELECT block, test, label, 'pred_raster', pred_raster FROM ps)"""
_SCORES = """
, cm AS ({counts}),
sn AS (SELECT arm, label AS class, sum(n) AS support, sum(CASE WHEN label = pred THEN n ELSE 0 END) AS hits FROM cm GROUP BY ALL),
sd AS (SELECT arm, pred AS class, sum(n) AS said FROM cm GROUP BY ALL),
pc AS (SELECT coalesce(sn.arm, sd.arm) AS arm, coalesce(sn.class, sd.class) AS class, cast(coalesce(support, 0) AS bigint) AS support, cast(coalesce(hits, 0) AS bigint) AS hits, cast(coalesce(said, 0) AS bigint) AS said
  FROM sn FULL JOIN sd ON sn.arm = sd.arm AND sn.class = sd.class),
pf AS (SELECT *, CASE WHEN said = 0 THEN 0 ELSE hits / cast(said AS double) END AS user_accuracy, CASE WHEN support = 0 THEN 0 ELSE hits / cast(support AS double) END AS producer_accuracy,
  CASE WHEN said + support = 0 THEN 0 ELSE 2 * hits / cast(said + support AS double) END AS f1 FROM pc),
ov AS (SELECT arm, cast(sum(support) AS bigint) AS n_test, round(sum(hits) / cast(sum(support) AS double), 6) AS overall_accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM pf GROUP BY arm)"""
_ARM_COUNTS = f"SELECT arm, label, pred, {_N} AS n FROM arms WHERE test GROUP BY arm, label, pred"
_MANIFEST = f"""
SELECT DISTINCT concat('T', cast(l_suppkey % 40 AS string), '_', CASE WHEN l_linenumber % 2 = 0 THEN '{PERIODS[0]}' ELSE '{PERIODS[1]}' END) AS item_id,
  concat('B0', cast(1 + l_partkey % 8 AS string)) AS asset_key, concat('https://assets.invalid/', cast(l_suppkey % 40 AS string), '/', cast(1 + l_partkey % 8 AS string)) AS asset_href FROM lineitem"""
_PARSED = "SELECT split_part(item_id, '_', 1) AS tile, substr(item_id, length(split_part(item_id, '_', 1)) + 2) AS period, asset_key AS band, asset_href FROM m"
_INVENTORY = """
SELECT concat('T', cast(ps_k % 30 AS string)) AS tile, {period} AS period, concat('B0', cast(1 + ps_k % 8 AS string)) AS band, ps_k % 11 <> 0 AS "exists",
  ps_k * 17 % 1000 AS size_bytes, CASE WHEN ps_k % 13 = 0 THEN -1 ELSE ps_k * 17 % 1000 + CASE WHEN ps_k % 7 = 0 THEN 5 ELSE 0 END END AS remote_bytes,
  ps_k % 11 <> 0 AND ps_k % 5 <> 0 AS intact FROM (SELECT cast(p_partkey AS bigint) AS ps_k FROM part)""".format(period=f"CASE WHEN ps_k % 2 = 0 THEN '{PERIODS[0]}' ELSE '{PERIODS[1]}' END")


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    own = spark.read.parquet(f"{d}/lineitem.parquet")
    tile, band = (F.col("l_suppkey") % 40).cast("string"), (1 + F.col("l_partkey") % 8).cast("string")
    when = F.when(F.col("l_linenumber") % 2 == 0, PERIODS[0]).otherwise(PERIODS[1])
    return own.select(F.concat(F.lit("T"), tile, F.lit("_"), when).alias("item_id"), F.concat(F.lit("B0"), band).alias("asset_key"), F.concat(F.lit("https://assets.invalid/"), tile, F.lit("/"), band).alias("asset_href")).distinct()


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("long")
    size = k * 17 % 1000
    return spark.read.parquet(f"{d}/part.parquet").select(
        F.concat(F.lit("T"), (k % 30).cast("string")).alias("tile"), F.when(k % 2 == 0, PERIODS[0]).otherwise(PERIODS[1]).alias("period"), F.concat(F.lit("B0"), (1 + k % 8).cast("string")).alias("band"),
        (k % 11 != 0).alias("exists"), size.alias("size_bytes"), F.when(k % 13 == 0, -1).otherwise(size + F.when(k % 7 == 0, 5).otherwise(0)).alias("remote_bytes"), ((k % 11 != 0) & (k % 5 != 0)).alias("intact"),
    )


def _dedup(spark, d, where=None):
    """Overlapping tiles merged, from the stored cells; ``where`` is about ids and centres only, and so may come first."""
    own = fx.cells(spark, d)
    return cells.cell_dedup(own if where is None else own.filter(where))


def _test(spark, d):
    return metrics.with_split(fx.paired(spark, d)).filter("test")


# sources and tables


@query(PX + CELL + "SELECT tile, cast(count(DISTINCT cell_id) AS bigint) AS n_cells, cast(count(*) AS bigint) AS n_pixels FROM cell GROUP BY tile")
def hive_scan(spark, d):
    return fx.cells(spark, d).filter(F.col("period") == PERIODS[0]).groupBy("tile").agg(F.count("*").alias("n_cells"), F.sum("n_pixels").alias("n_pixels"))


@query(_AGG + "SELECT tile, label, cast(count(*) AS bigint) AS n_cells, cast(sum(n_pixels) AS bigint) AS n_pixels FROM ca WHERE tile IN ('T1', 'T3') GROUP BY tile, label")
def list_scan(spark, d):
    own = store.read_tiles(spark, store.stored_path(fx.cells(spark, d)), PERIODS[0], ["T1", "T3"])
    return own.groupBy("tile", "label").agg(F.count("*").alias("n_cells"), F.sum("n_pixels").alias("n_pixels"))


@query(f"WITH m AS ({_MANIFEST}) SELECT *, concat(period, '/', tile, '/', band, '.tif') AS path FROM ({_PARSED})")
def manifest_parse(spark, d):
    return manifest.parse_manifest(_manifest(spark, d))


@query(f"WITH i AS ({_INVENTORY}) SELECT *, note = '' AS ok FROM (SELECT *, CASE WHEN NOT \"exists\" THEN 'missing' WHEN remote_bytes >= 0 AND size_bytes < remote_bytes THEN 'truncated' WHEN NOT intact THEN 'error' ELSE '' END AS note FROM i)")
def verify_tiles(spark, d):
    return manifest.verify_tiles(_inventory(spark, d))


@query(f"WITH i AS ({_INVENTORY}) SELECT * FROM i WHERE tile IN ('T1', 'T2', 'T3') AND period = '{PERIODS[0]}' AND band IN ('B01', 'B03', 'B04') AND NOT intact")
def repair_list(spark, d):
    return manifest.repair_list(_inventory(spark, d), ["T1", "T2", "T3"], PERIODS[0], ["B01", "B03", "B04"])


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_name LIKE 'Supplier#00000000%'")
def aoi_prefix_filter(spark, d):
    return manifest.prefix_filter(spark.read.parquet(f"{d}/supplier.parquet"), "s_name", "Supplier#00000000").select("s_suppkey", "s_name")


@query(
    "SELECT lat, lon, concat(CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END, lpad(cast(abs(lat) AS string), 2, '0'), CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END, lpad(cast(abs(lon) AS string), 3, '0')) AS name "
    "FROM (SELECT unnest(generate_series(-3, 57, 3)) AS lat), (SELECT unnest(generate_series(-9, 3, 3)) AS lon)"
)
def worldcover_tiles(spark, d):
    return manifest.cover_tiles(spark, (-6.5, -1.0, 3.0, 58.9))


@query(PX + "SELECT tile FROM (SELECT tile, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM pxl WHERE c < 60 * (1 + cast(substr(tile, 2) AS int)) GROUP BY tile) WHERE x0 <= -0.05 AND x1 >= -0.3 AND y0 <= 51.6 AND y1 >= 51.3")
def tiles_for_aoi(spark, d):
    strips = fx.pixels(spark, d).filter(F.col("c") < 60 * (1 + F.substring("tile", 2, 1).cast("int")))
    return manifest.tiles_for_aoi(manifest.footprints(strips, fx.STEP / 2), [[(-0.3, 51.3), (-0.05, 51.3), (-0.05, 51.6), (-0.3, 51.6), (-0.3, 51.3)]])


# pixels


@query(PX + f"SELECT tile, {_N} AS n, cast(count(*) FILTER (WHERE {' + '.join(BANDS)} > 0) AS bigint) AS n_valid FROM pxl GROUP BY tile")
def valid_pixels(spark, d):
    return fx.pixels(spark, d).groupBy("tile").agg(F.count("*").alias("n"), F.count_if(is_valid()).alias("n_valid"))


@query(PX + "SELECT tile, r, c, round(lon, 9) AS lon, round(lat, 9) AS lat FROM pxl")
def pixel_centres(spark, d):
    return _rounded(fx.pixels(spark, d).select("tile", "r", "c", "lon", "lat"), "lon", "lat", places=9)


@query("SELECT row_off, col_off, least(1024, 2500 - row_off) AS h, least(1024, 3000 - col_off) AS w FROM (SELECT unnest(generate_series(0, 2499, 1024)) AS row_off), (SELECT unnest(generate_series(0, 2999, 1024)) AS col_off)")
def block_grid(spark, d):
    return pixels.block_grid(spark, 2500, 3000)


@query(PX + f"SELECT wc_code, label, {_N} AS n FROM pxl GROUP BY ALL")
def label_remap(spark, d):
    return fx.pixels(spark, d).groupBy("wc_code", "label").agg(F.count("*").alias("n"))


_NAMES = "CASE label WHEN 1 THEN 'tree_cover' WHEN 2 THEN 'shrubland' WHEN 3 THEN 'grassland' WHEN 4 THEN 'cropland' WHEN 5 THEN 'built_up' WHEN 6 THEN 'bare' WHEN 7 THEN 'water' WHEN 8 THEN 'wetland' ELSE 'nodata' END"


@query(PX + f"SELECT {_NAMES} AS name, {_N} AS n FROM pxl GROUP BY ALL")
def class_counts(spark, d):
    return fx.pixels(spark, d).groupBy(class_name(F.col("label")).alias("name")).agg(F.count("*").alias("n"))


@query(PX + ", v AS (SELECT * FROM pxl WHERE label <> 0) SELECT r, c, label, tile FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY tile DESC) AS rn FROM v) WHERE rn = 1")
def mosaic(spark, d):
    return pixels.mosaic(fx.pixels(spark, d), "label")


@query(PX + "SELECT tile, r, c, B04 FROM pxl WHERE r % 4 = 0 AND c % 4 = 0")
def decimate(spark, d):
    return pixels.decimate(fx.pixels(spark, d), 4).select("tile", "r", "c", "B04")


_ND = "CASE WHEN ({a}) + ({b}) = 0 THEN cast(0 AS float) ELSE cast(cast(({a}) - ({b}) AS double) / cast(({a}) + ({b}) AS double) AS float) END"
_IND = ", ".join(f"{_ND.format(a=a, b=b)} AS {n}" for n, a, b in (("NDVI", "B08", "B04"), ("NDWI", "B03", "B08"), ("MNDWI", "B03", "B11"), ("NDBI", "B11", "B08"), ("BSI", "B11 + B04", "B08 + B02")))


@query(PX + f"SELECT tile, r, c, {_IND} FROM pxl")
def spectral_features(spark, d):
    return fx.pixels(spark, d).withColumns(indices()).select("tile", "r", "c", *INDICES)


@query(PX + ", co AS (SELECT tile, r, c, B11 FROM pxl WHERE r < 125 AND c < 120) SELECT f.tile, f.r, f.c, f.B04, co.B11 FROM pxl f LEFT JOIN co ON co.tile = f.tile AND co.r = f.r // 2 AND co.c = f.c // 2")
def band_stack(spark, d):
    own = fx.pixels(spark, d)
    return pixels.band_stack(own.select("tile", "r", "c", "B04"), own.filter("r < 125 and c < 120").select("tile", "r", "c", "B11"), 2, "B11")


def _in_polygon(lon: str = "lon", lat: str = "lat") -> str:
    ring = POLYGON[0]
    edges = [(p, q) for p, q in zip(ring, ring[1:], strict=False) if p[1] != q[1]]
    tests = [f"(CASE WHEN ((cast({y0!r} AS double) > {lat}) <> (cast({y1!r} AS double) > {lat})) AND {lon} < cast({(x1 - x0) / (y1 - y0)!r} AS double) * ({lat} - cast({y0!r} AS double)) + cast({x0!r} AS double) THEN 1 ELSE 0 END)" for (x0, y0), (x1, y1) in edges]
    return f"({' + '.join(tests)}) % 2 = 1"


@query(PX + f"SELECT tile, {_N} AS n FROM pxl WHERE {_in_polygon()} GROUP BY tile")
def cutline(spark, d):
    return pixels.cutline(fx.pixels(spark, d), POLYGON).groupBy("tile").agg(F.count("*").alias("n"))


@query(PX + ", co AS (SELECT r, c, max(wc_code) AS wc_code FROM pxl WHERE r < 160 AND c < 160 GROUP BY r, c), kk AS (SELECT tile, r, c, cast(floor((lat - 51.7::double) / (-0.003)::double) AS bigint) AS rr, cast(floor((lon - (-0.5)::double) / 0.003::double) AS bigint) AS cc FROM pxl) SELECT kk.tile, kk.r, kk.c, coalesce(co.wc_code, 0) AS wc_code FROM kk LEFT JOIN co ON co.r = rr AND co.c = cc")
def reproject_nearest(spark, d):
    own = fx.pixels(spark, d)
    source = own.filter("r < 160 and c < 160").groupBy("r", "c").agg(F.max("wc_code").alias("wc_code"))
    return pixels.reproject_nearest(own.select("tile", "r", "c", "lon", "lat"), source, "wc_code", (fx.WEST, fx.NORTH), (0.003, -0.003)).select("tile", "r", "c", "wc_code")


_CORNERS = ", ".join(f"max(CASE WHEN k = {k} THEN v END) AS v{k}" for k in range(4))
_CORNER = "CASE WHEN v{k} IS NOT NULL THEN {w} ELSE 0::double END"
_WEIGHTS = ", ".join(f"{_CORNER.format(k=k, w=w)} AS w{k}" for k, w in enumerate(("(1 - fy) * (1 - fx)", "(1 - fy) * fx", "fy * (1 - fx)", "fy * fx")))


@query(
    PX + f"""
, co AS (SELECT r, c, max(B08) AS v FROM pxl WHERE r < 160 AND c < 160 GROUP BY r, c),
sq AS (SELECT r - (k // 2) AS rr, c - (k % 2) AS cc, k, v FROM co, (SELECT unnest(generate_series(0, 3)) AS k) WHERE v <> 0),
qd AS (SELECT rr, cc, {_CORNERS} FROM sq GROUP BY rr, cc),
kk AS (SELECT tile, r, c, (lat - 51.7::double) / (-0.003)::double - 0.5::double AS y, (lon - (-0.5)::double) / 0.003::double - 0.5::double AS x FROM pxl),
jj AS (SELECT tile, r, c, y - floor(y) AS fy, x - floor(x) AS fx, v0, v1, v2, v3 FROM kk LEFT JOIN qd ON rr = cast(floor(y) AS bigint) AND cc = cast(floor(x) AS bigint)),
ww AS (SELECT *, {_WEIGHTS} FROM jj)
SELECT tile, r, c, cast(CASE WHEN w0 + w1 + w2 + w3 > 0 THEN floor((w0 * coalesce(v0, 0) + w1 * coalesce(v1, 0) + w2 * coalesce(v2, 0) + w3 * coalesce(v3, 0)) / (w0 + w1 + w2 + w3) + 0.5::double) ELSE 0 END AS int) AS B08 FROM ww"""
)
def reproject_bilinear(spark, d):
    own = fx.pixels(spark, d)
    source = own.filter("r < 160 and c < 160").groupBy("r", "c").agg(F.max("B08").alias("B08"))
    return pixels.reproject_bilinear(own.select("tile", "r", "c", "lon", "lat"), source, "B08", (fx.WEST, fx.NORTH), (0.003, -0.003)).select("tile", "r", "c", "B08")


@query("""
WITH g AS (SELECT 6378137.0::double AS a, (1 / 298.257223563::double) * (2 - 1 / 298.257223563::double) AS e2, radians(51.5::double) AS p),
w AS (SELECT *, sqrt(1 - e2 * sin(p) * sin(p)) AS w, 10.0::double * cos(p) AS ground FROM g)
SELECT 'london' AS aoi, 'EPSG:4326' AS crs, 51.5::double AS centroid_lat, 'EPSG:3857' AS source_crs, 10.0::double AS source_res_m, round(ground, 9) AS native_ground_res_m, round(ground, 9) AS ground_res_m,
  round(ground / (radians(1) * a / w * cos(p)), 12) AS x_deg, round(ground / (radians(1) * a * (1 - e2) / pow(w, 3)), 12) AS y_deg, 'bilinear' AS resampling FROM w""")
def grid_spec_(spark, d):
    out = spark.createDataFrame([grid_spec("london", 51.5, 10.0)])
    return _rounded(_rounded(out, "native_ground_res_m", "ground_res_m", places=9), "x_deg", "y_deg", places=12)


# the grid


@query(PX + CELL + "SELECT tile, r, c, cell_id FROM cell")
def point_to_cell(spark, d):
    return fx.indexed(spark, d).select("tile", "r", "c", "cell_id")


@query(PX + CELL + "SELECT DISTINCT cell_id, round((ix + 0.5::double) / 81920 * 360 - 180, 9) AS lon, round(degrees(asin((iy + 0.5::double) / 49152 * 2 - 1)), 9) AS lat FROM cell")
def cell_centroid(spark, d):
    own = fx.indexed(spark, d).select("cell_id").distinct().withColumn("p", grid.cell_to_point(F.col("cell_id"), L))
    return own.select("cell_id", F.round("p.lon", 9).alias("lon"), F.round("p.lat", 9).alias("lat"))


@query("SELECT level, round(4 * pi() * 6371007.1809::double * 6371007.1809::double / (60 * pow(4, level - 1)), 6) AS area_m2 FROM (SELECT unnest(generate_series(12, 20)) AS level)")
def level_area(spark, d):
    return spark.createDataFrame([(k, round(grid.cell_area_m2(k), 6)) for k in range(12, 21)], "level long, area_m2 double")


@query(_DISK + "SELECT cell_id FROM ids")
def grid_disk(spark, d):
    return spark.range(1).select(F.explode(grid.grid_disk(F.lit(grid.cell_of(*SPOT, L)), L, 8)).alias("cell_id"))


# cells


@query(_AGG + "SELECT * FROM ca")
def cell_aggregate(spark, d):
    return cells.cell_aggregate(fx.indexed(spark, d))


@query(_DEDUP + f"SELECT cell_id, n_pixels, {_BANDS}, label, tile FROM dd")
def cell_dedup(spark, d):
    return _dedup(spark, d)


@query(PX + CELL + ", n AS (SELECT cell_id, label, count(*) AS n FROM cell WHERE label <> 0 GROUP BY ALL), kk AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, label) AS rn, sum(n) OVER (PARTITION BY cell_id) AS s FROM n) SELECT cell_id, label AS value, cast(s AS bigint) AS n_pixels FROM kk WHERE rn = 1")
def raster_majority(spark, d):
    return cells.raster_majority(fx.indexed(spark, d))


@query(_STATS + "SELECT cell_id, n_pixels, label_purity FROM st")
def label_purity(spark, d):
    return cells.cell_stats(fx.indexed(spark, d)).select("cell_id", "n_pixels", "label_purity")


@query(_STATS + "SELECT cell_id, round(b08_std, 6) AS b08_std, round(b08_mean, 6) AS b08_mean FROM st")
def b08_spread(spark, d):
    return _rounded(cells.cell_stats(fx.indexed(spark, d)).select("cell_id", "b08_std", "b08_mean"), "b08_std", "b08_mean")


@query(_STATS + "SELECT cell_id, n_pixels, label_purity, round(b08_std, 6) AS b08_std, round(b08_mean, 6) AS b08_mean FROM st")
def cell_stats(spark, d):
    return _rounded(cells.cell_stats(fx.indexed(spark, d)), "b08_std", "b08_mean")


@query(_STATS + "SELECT cell_id, n_pixels, label_purity FROM st")
def bucket_union(spark, d):
    own, out = fx.indexed(spark, d), None
    for k in range(4):  # parts by hash of the cell, joined again: the same as the whole
        part = cells.cell_stats(own.filter(F.pmod(F.xxhash64("cell_id"), F.lit(4)) == k))
        out = part if out is None else out.unionByName(part)
    return out.select("cell_id", "n_pixels", "label_purity")


# samples and splits


@query(PX + f", b AS (SELECT *, {_BLOCK} AS block FROM pxl) SELECT block, {_TEST} AS test, {_N} AS n FROM b GROUP BY ALL")
def block_split(spark, d):
    own = fx.pixels(spark, d).withColumn("block", grid.block_id(F.col("lon"), F.col("lat")))
    return own.groupBy("block").agg(F.count("*").alias("n")).withColumn("test", grid.is_test(F.col("block")))


_CELL_XY = "round((ix + 0.5::double) / 81920 * 360 - 180, 12) AS lon, round(degrees(asin((iy + 0.5::double) / 49152 * 2 - 1)), 9) AS lat"
_CENTRES = f", ctr AS (SELECT DISTINCT cell_id, {_CELL_XY} FROM cell)"


@query(_AGG + _CENTRES + f", sc AS (SELECT tile, label, cell_id, n_pixels FROM (SELECT *, row_number() OVER (PARTITION BY tile, label ORDER BY md5(cast(cell_id AS string)), cell_id) AS rn FROM ca WHERE label <> 0) WHERE rn <= 50), sb AS (SELECT sc.*, round(lon, 9) AS lon, lat, {_BLOCK} AS block, {L} AS level FROM sc JOIN ctr USING (cell_id)) SELECT *, {_TEST} AS test FROM sb")
def sample_cells(spark, d):
    return _rounded(sampling.sample_cells(fx.cells(spark, d), 50, level=L).select("tile", "label", "cell_id", "n_pixels", "lon", "lat", "block", "level", "test"), "lon", places=9)


@query(PX + "SELECT tile, label, r, c FROM (SELECT *, row_number() OVER (PARTITION BY tile, label ORDER BY md5(concat('42:', tile, ':', r, ':', c)), r, c) AS rn FROM pxl WHERE label <> 0) WHERE rn <= 20")
def sample_pixels(spark, d):
    return sampling.sample_pixels(fx.pixels(spark, d), 20).select("tile", "label", "r", "c")


@query(_DEDUP + "SELECT cell_id, n_pixels, label FROM dd ORDER BY md5(cast(cell_id AS string)), cell_id LIMIT 1000")
def train_cap(spark, d):
    return sampling.train_cap(_dedup(spark, d), 1000).select("cell_id", "n_pixels", "label")


# comparison and validation


@query(PX + CELL + PAIRED + "SELECT cell_id, label, n_pixels, label_purity, round(b08_std, 6) AS b08_std, round(b08_mean, 6) AS b08_mean, pred_a5, pred_a5_transfer, pred_raster, round(lon, 9) AS lon, lat FROM paired")
def paired_table(spark, d):
    return _rounded(_rounded(fx.paired(spark, d), "b08_std", "b08_mean"), "lon", places=9)


@query(_SPLIT + _ARM_COUNTS)
def confusion_cells(spark, d):
    return metrics.confusion(metrics.arms(_test(spark, d)), "arm")


_PIXEL_PRED = "CASE WHEN (r * 7919 + c * 104729) % 100 < 70 THEN label ELSE (label + 4) % 8 + 1 END"


def _pixel_predictions(spark, d):
    pred = F.when((F.col("r") * 7919 + F.col("c") * 104729) % 100 < 70, F.col("label")).otherwise((F.col("label") + 4) % 8 + 1)
    return fx.pixels(spark, d).filter("label > 0").withColumn("pred", pred)


def _pixel_counts(spark, d):
    return metrics.confusion(_pixel_predictions(spark, d))


@query(PX + f"SELECT label, {_PIXEL_PRED} AS pred, {_N} AS n FROM pxl WHERE label > 0 GROUP BY ALL")
def pixel_confusion(spark, d):
    return _pixel_counts(spark, d)


@query(PX + f", kk AS (SELECT label, {_PIXEL_PRED} AS pred, {_N} AS n FROM pxl WHERE label > 0 GROUP BY ALL) SELECT *, round(n / cast(sum(n) OVER (PARTITION BY label) AS double), 6) AS share FROM kk")
def confusion_normalised(spark, d):
    return _rounded(metrics.confusion_normalised(_pixel_counts(spark, d)), "share")


@query(_SPLIT + _SCORES.format(counts=_ARM_COUNTS) + "SELECT arm, class, round(user_accuracy, 6) AS user_accuracy, round(producer_accuracy, 6) AS producer_accuracy, round(f1, 6) AS f1, support FROM pf")
def metrics_per_class(spark, d):
    out = metrics.metrics_per_class(metrics.confusion(metrics.arms(_test(spark, d)), "arm"), "arm").drop("hits")
    return _rounded(out, "user_accuracy", "producer_accuracy", "f1")


@query(PX + _SCORES.format(counts=f"SELECT 'pixels' AS arm, label, {_PIXEL_PRED} AS pred, {_N} AS n FROM pxl WHERE label > 0 GROUP BY ALL") + "SELECT * FROM ov")
def metrics_overall(spark, d):
    return _rounded(metrics.metrics_overall(_pixel_counts(spark, d).withColumn("arm", F.lit("pixels")), "arm"), "overall_accuracy", "macro_f1", "weighted_f1")


@query(_SPLIT + _SCORES.format(counts=_ARM_COUNTS) + "SELECT * FROM ov")
def compare_scores(spark, d):
    return _rounded(metrics.metrics_overall(metrics.confusion(metrics.arms(_test(spark, d)), "arm"), "arm"), "overall_accuracy", "macro_f1", "weighted_f1")


@query(_SPLIT + ", kk AS (SELECT cast(count(*) FILTER (WHERE pred_a5 = label AND pred_raster <> label) AS bigint) AS b, cast(count(*) FILTER (WHERE pred_a5 <> label AND pred_raster = label) AS bigint) AS c FROM ps WHERE test) SELECT b, c, CASE WHEN b + c = 0 THEN 0 ELSE round(pow(abs(b - c) - 1, 2) / cast(b + c AS double), 6) END AS statistic FROM kk")
def mcnemar(spark, d):
    return _rounded(metrics.mcnemar_counts(_test(spark, d)), "statistic")


@query(PX + CELL + PAIRED + f"SELECT {_N} AS n_cells, round(avg(label_purity), 6) AS mean_purity, round(avg(b08_std), 6) AS mean_b08_std, round(avg(CASE WHEN abs(b08_mean) > 1e-6 THEN b08_std / b08_mean END), 6) AS mean_b08_cv, round(count(*) FILTER (WHERE label_purity >= 1) / cast(count(*) AS double), 6) AS pure_fraction FROM paired")
def info_loss(spark, d):
    return _rounded(metrics.info_loss(fx.paired(spark, d)), "mean_purity", "mean_b08_std", "mean_b08_cv", "pure_fraction")


@query(PX + CELL + PAIRED + f"SELECT label, {_N} AS n_cells, round(count(*) FILTER (WHERE label_purity < 1) / cast(count(*) AS double), 6) AS mixed_fraction FROM paired GROUP BY label")
def mixed_by_class(spark, d):
    return _rounded(metrics.mixed_by_class(fx.paired(spark, d)), "mixed_fraction")


@query(_SPLIT + f"SELECT CASE WHEN label_purity >= 1 THEN 'pure' WHEN label_purity >= 0.75 THEN '0.75-1.0' ELSE '<0.75' END AS band, {_N} AS n, cast(count(*) FILTER (WHERE pred_a5 = label) AS bigint) AS correct, round(count(*) FILTER (WHERE pred_a5 = label) / cast(count(*) AS double), 6) AS accuracy FROM ps WHERE test GROUP BY 1")
def accuracy_by_purity(spark, d):
    return _rounded(metrics.accuracy_by_purity(_test(spark, d)), "accuracy")


_HIGH = "FROM ps WHERE test AND label_purity >= 0.95"


@query(_SPLIT + f"SELECT {_N} AS n, " + ", ".join(f"cast(count(*) FILTER (WHERE pred_a5_transfer {a} label AND pred_raster {b} label) AS bigint) AS {n}" for n, a, b in (("both", "=", "="), ("transfer_only", "=", "<>"), ("raster_only", "<>", "="), ("neither", "<>", "<>"))) + f" {_HIGH}")
def audit_high_purity(spark, d):
    return metrics.audit_high_purity(_test(spark, d))


@query(_SPLIT + f"SELECT cell_id, label, pred_raster, round(lon, 9) AS lon, lat {_HIGH} AND pred_a5_transfer = label AND pred_raster <> label ORDER BY cell_id LIMIT 40")
def audit_samples(spark, d):
    return _rounded(metrics.audit_samples(_test(spark, d)), "lon", places=9)


@query(_SPLIT + f"SELECT block, arm, label, pred, {_N} AS n FROM arms WHERE test GROUP BY ALL")
def block_confusion(spark, d):
    return validation.block_confusion(_test(spark, d))


@query(_SPLIT + _SCORES.format(counts=f"SELECT 'x' AS arm, label, pred_a5_transfer AS pred, {_N} AS n FROM ps WHERE test GROUP BY ALL") + "SELECT n_test, overall_accuracy, macro_f1, weighted_f1 FROM ov")
def external_score(spark, d):
    own = fx.paired(spark, d)
    return _rounded(metrics.external_score(own, own.select("cell_id", "label", F.col("pred_a5_transfer").alias("pred"))), "overall_accuracy", "macro_f1", "weighted_f1")


@query(PX + CELL + PAIRED + "SELECT round(quantile_cont(b08_mean, 0.025), 6) AS q0, round(quantile_cont(b08_mean, 0.975), 6) AS q1 FROM paired")
def bootstrap_quantile(spark, d):
    return _rounded(validation.quantiles(fx.paired(spark, d), "b08_mean"), "q0", "q1")


@query()
def bootstrap_ci(spark, d):
    return spark.createDataFrame(validation.bootstrap(validation.block_confusion(_test(spark, d))))


@query()
def pixel_bootstrap(spark, d):
    own = _pixel_predictions(spark, d).withColumn("block", grid.block_id(F.col("lon"), F.col("lat")))
    return spark.createDataFrame(validation.pixel_bootstrap(own.filter(grid.is_test(F.col("block")))))


@query()
def rf_predict(spark, d):
    own = _dedup(spark, d).filter("label <> 0")
    fitted = model.train(sampling.train_cap(own, 2000), trees=20, depth=10)
    return model.predict(fitted, own).select("cell_id", "label", "pred")


# the paired benchmark, on cells and on pixels


@query(_DEDUP + f", s AS (SELECT {_SPOT_XY}) SELECT dd.cell_id, B04, B08 FROM dd WHERE cell_id = (SELECT any_value(cell_id) FROM cell, s WHERE ix = x0 AND iy = y0)")
def bench_point_cell(spark, d):
    return _dedup(spark, d, F.col("cell_id") == grid.cell_of(*SPOT, L)).select("cell_id", "B04", "B08")


_PX_AT = f"r = cast(floor(({SPOT[1]}::double - 51.7::double) / (-0.002)::double) AS bigint) AND c = cast(floor(({SPOT[0]}::double - (-0.5)::double) / 0.002::double) AS bigint)"


@query(PX + f"SELECT tile, r, c, B04, B08 FROM pxl WHERE {_PX_AT}")
def bench_point_pixel(spark, d):
    at = (F.col("r") == pixels.pixel_at(F.lit(SPOT[1]), fx.NORTH, -fx.STEP)) & (F.col("c") == pixels.pixel_at(F.lit(SPOT[0]), fx.WEST, fx.STEP))
    return fx.pixels(spark, d).filter(at).select("tile", "r", "c", "B04", "B08")


@query(_DEDUP + f", s AS (SELECT {_SPOT_XY}), nb AS (SELECT DISTINCT cell_id FROM cell, s WHERE abs(ix - x0) + abs(iy - y0) <= 8) SELECT {_N} AS n, round(avg(cast(B08 AS double)), 6) AS b08 FROM dd WHERE cell_id IN (SELECT cell_id FROM nb)")
def bench_neighbourhood(spark, d):
    disk = grid.disk_of(grid.xy_of(*SPOT, L), L, 8)  # 145 cells
    own = _dedup(spark, d, F.col("cell_id").between(disk[0], disk[-1]) & F.col("cell_id").isin(disk))
    return _rounded(own.agg(F.count("*").alias("n"), F.avg(F.col("B08").cast("double")).alias("b08")), "b08")


_WINDOW = f"lon BETWEEN {SPOT[0]}::double - 0.01::double AND {SPOT[0]}::double + 0.01::double AND lat BETWEEN {SPOT[1]}::double - 0.01::double AND {SPOT[1]}::double + 0.01::double"


@query(PX + f"SELECT {_N} AS n, round(avg(B08), 6) AS b08 FROM pxl WHERE label > 0 AND {_WINDOW}")
def bench_window_pixel(spark, d):
    x, y = SPOT
    own = fx.pixels(spark, d).filter(within_box(F.col("lon"), F.col("lat"), (x - 0.01, y - 0.01, x + 0.01, y + 0.01)) & (F.col("label") > 0))
    return _rounded(own.agg(F.count("*").alias("n"), F.avg("B08").alias("b08")), "b08")


@query(_DEDUP + _CENTRES + f"SELECT {_N} AS n, round(avg(cast(B08 AS double)), 6) AS b08 FROM dd JOIN ctr USING (cell_id) WHERE {_in_polygon()}")
def bench_zonal_cell(spark, d):
    ranges = [F.col("cell_id").between(lo, hi) for lo, hi in grid.cover(bounds(POLYGON), L)]  # few, for scans to prune by
    own = _dedup(spark, d, reduce(lambda a, b: a | b, ranges) & within(F.col("lon"), F.col("lat"), POLYGON))
    return _rounded(own.agg(F.count("*").alias("n"), F.avg(F.col("B08").cast("double")).alias("b08")), "b08")


@query(PX + f"SELECT {_N} AS n, round(avg(B08), 6) AS b08 FROM pxl WHERE B08 > 0 AND {_in_polygon()}")
def bench_zonal_pixel(spark, d):
    own = pixels.cutline(fx.pixels(spark, d).filter("B08 > 0"), POLYGON)
    return _rounded(own.agg(F.count("*").alias("n"), F.avg("B08").alias("b08")), "b08")


@query(_AGG + "SELECT label, round(avg(cast(B08 AS double)), 6) AS b08 FROM ca GROUP BY label")
def bench_group_cell(spark, d):
    return _rounded(fx.cells(spark, d).groupBy("label").agg(F.avg(F.col("B08").cast("double")).alias("b08")), "b08")


@query(PX + ", kk AS (SELECT unnest(generate_series(0, 8)) AS label), g AS (SELECT label, sum(B08) AS s, count(*) AS n FROM pxl WHERE label > 0 GROUP BY label) SELECT cast(kk.label AS int) AS label, round(coalesce(s, 0) / cast(greatest(coalesce(n, 0), 1) AS double), 6) AS b08 FROM kk LEFT JOIN g ON g.label = kk.label")
def bench_group_pixel(spark, d):
    sums = fx.pixels(spark, d).filter("label > 0").groupBy("label").agg(F.sum("B08").alias("s"), F.count("*").alias("n"))
    classes = spark.range(9).select(F.col("id").cast("int").alias("label"))
    out = classes.join(sums, "label", "left").fillna(0)
    return _rounded(out.select("label", (F.col("s") / F.greatest("n", F.lit(1))).alias("b08")), "b08")


_INDEX = ", pi AS (SELECT p.*, c.ix, c.iy FROM paired p JOIN (SELECT DISTINCT cell_id, ix, iy FROM cell) c ON c.cell_id = p.cell_id)"


@query(PX + CELL + PAIRED + _INDEX + f"SELECT cell_id, label, pred_a5, pred_raster, pred_a5 = pred_raster AS agree, round(ix / cast(81920 AS double) * 360 - 180, 9) AS west, round(degrees(asin(iy / cast(49152 AS double) * 2 - 1)), 9) AS south FROM pi WHERE lon BETWEEN {BOX[0]}::double AND {BOX[2]}::double AND lat BETWEEN {BOX[1]}::double AND {BOX[3]}::double")
def cell_map(spark, d):
    own = fx.paired(spark, d).filter(within_box(F.col("lon"), F.col("lat"), BOX)).withColumn("ring", grid.cell_ring(F.col("cell_id"), L))
    return own.select("cell_id", "label", "pred_a5", "pred_raster", (F.col("pred_a5") == F.col("pred_raster")).alias("agree"), F.col("ring")[0]["x"].alias("west"), F.col("ring")[0]["y"].alias("south"))
