"""Queries without SQL over their whole tables."""

import math
import os

import pytest

from cellmosaic.plans import fixtures as fx
from cellmosaic.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def test_reproject_bilinear_takes_all_tiles(spark):
    """Against brute force over the pixels of every tile."""
    if not os.path.isdir(DIR):
        pytest.skip("no test data here")
    own = fx.pixels(spark, DIR).select("tile", "r", "c", "lon", "lat", "B08").collect()
    source = {}
    for p in own:
        if p["r"] < 160 and p["c"] < 160:
            source[p["r"], p["c"]] = max(p["B08"], source.get((p["r"], p["c"]), 0))
    got = {(p["tile"], p["r"], p["c"]): p["B08"] for p in QUERIES["reproject_bilinear"](spark, DIR).collect()}
    assert len({t for t, _, _ in got}) == 4 and len(got) == len(own)
    for p in own:
        y, x = (p["lat"] - fx.NORTH) / -0.003 - 0.5, (p["lon"] - fx.WEST) / 0.003 - 0.5
        total = mean = 0.0
        for r in (math.floor(y), math.floor(y) + 1):
            for c in (math.floor(x), math.floor(x) + 1):
                if source.get((r, c), 0):
                    w = (1 - abs(y - r)) * (1 - abs(x - c))
                    total, mean = total + w, mean + w * source[r, c]
        want = {math.floor(mean / total + 0.5 + e) for e in (-1e-6, 1e-6)} if total > 0 else {0}
        assert got[p["tile"], p["r"], p["c"]] in want
