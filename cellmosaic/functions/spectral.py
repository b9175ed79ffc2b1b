"""Spectral indices and the pixel mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellmosaic.config import BANDS, CLASS_NAMES, CODE_TO_CLASS


def norm_diff(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where that sum is 0."""
    return F.when(a + b == 0, F.lit(0.0)).otherwise((a - b).cast("double") / (a + b).cast("double")).cast("float")


def indices() -> dict[str, Column]:
    b = {x: F.col(x) for x in BANDS}
    return {
        "NDVI": norm_diff(b["B08"], b["B04"]), "NDWI": norm_diff(b["B03"], b["B08"]), "MNDWI": norm_diff(b["B03"], b["B11"]),
        "NDBI": norm_diff(b["B11"], b["B08"]), "BSI": norm_diff(b["B11"] + b["B04"], b["B08"] + b["B02"]),
    }


def is_valid() -> Column:
    """Pixels with any reflectance at all."""
    return F.expr(f"{' + '.join(BANDS)} > 0")


def class_of(code: Column) -> Column:
    """Land-cover code to class, 0 for unknown codes."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CODE_TO_CLASS.items() for x in kv])[code], F.lit(0))


def class_name(label: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CLASS_NAMES.items() for x in kv])[label]
