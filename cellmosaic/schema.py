"""Explicit schemas of tables at rest."""

from pyspark.sql import types as T

from cellmosaic.config import BANDS

_f = T.StructField
MANIFEST = T.StructType([_f(n, T.StringType()) for n in ("item_id", "asset_key", "asset_href")])
INVENTORY = T.StructType(
    [_f(n, T.StringType()) for n in ("tile", "period", "band", "path", "asset_href")]
    + [_f("exists", T.BooleanType()), _f("size_bytes", T.LongType()), _f("remote_bytes", T.LongType()), _f("intact", T.BooleanType())]
)
PIXELS = T.StructType([_f("tile", T.StringType()), _f("r", T.LongType()), _f("c", T.LongType()), _f("lon", T.DoubleType()), _f("lat", T.DoubleType()), *(_f(b, T.IntegerType()) for b in BANDS), _f("label", T.IntegerType())])
CELLS = T.StructType([_f("cell_id", T.LongType()), _f("n_pixels", T.LongType()), *(_f(b, T.FloatType()) for b in BANDS), _f("label", T.IntegerType()), _f("period", T.StringType()), _f("tile", T.StringType())])
CELL_PREDICTION = T.StructType([_f("cell_id", T.LongType()), _f("label", T.IntegerType()), _f("pred", T.IntegerType())])
CELL_STATS = T.StructType([_f("cell_id", T.LongType()), _f("n_pixels", T.LongType()), _f("label_purity", T.DoubleType()), _f("b08_std", T.DoubleType()), _f("b08_mean", T.DoubleType())])
