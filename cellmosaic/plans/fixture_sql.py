"""The fixture as SQL text that DuckDB runs, to hold the queries against."""

PX = """
WITH raw AS (
  SELECT concat('T', cast(l_suppkey % 4 AS string)) AS tile,
         cast(l_partkey % 250 AS bigint) AS r, cast(l_orderkey % 240 AS bigint) AS c,
         max(cast(l_quantity AS bigint)) AS q,
         max(cast(floor(l_extendedprice) AS bigint)) AS e,
         max(cast(l_linenumber AS bigint)) AS ln
  FROM lineitem GROUP BY 1, 2, 3),
k AS (
  SELECT *, CASE WHEN (r + c) % 37 = 0 THEN 0 ELSE 1 END AS v,
         (cast(floor(r / cast(6 AS double)) AS bigint) + cast(floor(c / cast(6 AS double)) AS bigint)
          + CASE WHEN ln >= 6 THEN 1 ELSE 0 END) % 11 AS ki
  FROM raw),
px AS (
  SELECT tile, r, c,
    cast(-0.5 AS double) + (c + cast(0.5 AS double)) * cast(0.002 AS double) AS lon,
    cast(51.7 AS double) - (r + cast(0.5 AS double)) * cast(0.002 AS double) AS lat,
    cast(v * (120 + q * 13) AS int) AS B01,
    cast(v * (150 + q * 40) AS int) AS B02,
    cast(v * (180 + (e * 3) % 1900) AS int) AS B03,
    cast(v * (200 + e % 3000) AS int) AS B04,
    cast(v * (210 + (e * 11) % 2700) AS int) AS B05,
    cast(v * (250 + (e * 13) % 3100) AS int) AS B06,
    cast(v * (270 + (e * 17) % 3700) AS int) AS B07,
    cast(v * (300 + (e + 37 * q) % 5000) AS int) AS B08,
    cast(v * (310 + (e * 19) % 4100) AS int) AS B8A,
    cast(v * (90 + ln * 100) AS int) AS B09,
    cast(v * (100 + (e * 7) % 2500) AS int) AS B11,
    cast(v * (80 + (e * 5) % 2300) AS int) AS B12,
    CASE WHEN v = 0 THEN 0
         ELSE CASE ki WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 40 WHEN 4 THEN 50 WHEN 5 THEN 60
                      WHEN 6 THEN 70 WHEN 7 THEN 80 WHEN 8 THEN 90 WHEN 9 THEN 95 ELSE 100 END END AS wc_code
  FROM k),
pxl AS (
  SELECT *, CASE wc_code WHEN 10 THEN 1 WHEN 20 THEN 2 WHEN 30 THEN 3 WHEN 40 THEN 4 WHEN 50 THEN 5 WHEN 60 THEN 6
                 WHEN 70 THEN 0 WHEN 80 THEN 7 WHEN 90 THEN 8 WHEN 95 THEN 8 WHEN 100 THEN 2 ELSE 0 END AS label
  FROM px)
"""

CELL = """
, ij AS (
  SELECT *, cast(floor((lon + cast(180 AS double)) / cast(360 AS double) * cast(81920 AS double)) AS bigint) AS ix,
            cast(floor((sin(radians(lat)) + cast(1 AS double)) / cast(2 AS double) * cast(49152 AS double)) AS bigint) AS iy
  FROM pxl
  WHERE B01 + B02 + B03 + B04 + B05 + B06 + B07 + B08 + B8A + B09 + B11 + B12 > 0),
f  AS (SELECT *, (ix >> 13) * 6 + (iy >> 13) AS face, ix & 8191 AS fx, iy & 8191 AS fy FROM ij),
m1 AS (SELECT *, (fx | (fx << 16)) & 281470681808895 AS a1, (fy | (fy << 16)) & 281470681808895 AS b1 FROM f),
m2 AS (SELECT *, (a1 | (a1 << 8)) & 71777214294589695 AS a2, (b1 | (b1 << 8)) & 71777214294589695 AS b2 FROM m1),
m3 AS (SELECT *, (a2 | (a2 << 4)) & 1085102592571150095 AS a3, (b2 | (b2 << 4)) & 1085102592571150095 AS b3 FROM m2),
m4 AS (SELECT *, (a3 | (a3 << 2)) & 3689348814741910323 AS a4, (b3 | (b3 << 2)) & 3689348814741910323 AS b4 FROM m3),
m5 AS (SELECT *, (a4 | (a4 << 1)) & 6148914691236517205 AS a5, (b4 | (b4 << 1)) & 6148914691236517205 AS b5 FROM m4),
cell AS (
  SELECT *, ((((face << 26) | a5 | (b5 << 1)) << 1) | 1) << 24 AS cell_id FROM m5)
"""

PAIRED = """
, cnt AS (SELECT cell_id, ix, iy, label, count(*) AS n FROM cell GROUP BY cell_id, ix, iy, label),
rk AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, label) AS rn,
              cast(sum(n) OVER (PARTITION BY cell_id) AS bigint) AS n_pixels FROM cnt),
maj AS (SELECT cell_id, ix, iy, label, n_pixels, n / cast(n_pixels AS double) AS label_purity FROM rk WHERE rn = 1),
spread AS (
  SELECT cell_id, avg(B08) AS b08_mean,
         sqrt(cast(count(*) * sum(cast(B08 AS bigint) * B08) - sum(B08) * sum(B08) AS double)) / count(*) AS b08_std
  FROM cell GROUP BY cell_id),
paired AS (
  SELECT m.cell_id, m.label, m.n_pixels, m.label_purity, s.b08_std, s.b08_mean,
         CASE WHEN (ix * 7919 + iy * 104729) % 100 < 75 THEN label ELSE label % 8 + 1 END AS pred_a5,
         CASE WHEN (ix * 104729 + iy * 1299709) % 100 < 65 THEN label ELSE (label + 2) % 8 + 1 END AS pred_a5_transfer,
         CASE WHEN (ix * 15485863 + iy * 7919) % 100 < 70 THEN label ELSE (label + 4) % 8 + 1 END AS pred_raster,
         (ix + cast(0.5 AS double)) / cast(81920 AS double) * cast(360 AS double) - cast(180 AS double) AS lon,
         round(degrees(asin((iy + cast(0.5 AS double)) / cast(49152 AS double) * cast(2 AS double) - cast(1 AS double))), 9) AS lat
  FROM maj m JOIN spread s ON m.cell_id = s.cell_id
  WHERE m.label <> 0)
"""
