"""The target grid of a warp: metres to degrees at a latitude."""

from __future__ import annotations

import math

_A, _F = 6378137.0, 1 / 298.257223563  # WGS84


def degree_lengths_m(lat: float) -> tuple[float, float]:
    """Metres in a degree of longitude and of latitude, from the ellipsoid's radii of curvature."""
    e2, s = _F * (2 - _F), math.sin(math.radians(lat))
    w = math.sqrt(1 - e2 * s * s)
    return math.radians(1) * _A / w * math.cos(math.radians(lat)), math.radians(1) * _A * (1 - e2) / w**3


def grid_spec(aoi: str, centre_lat: float, source_res_m: float, ground_res_m: float | None = None, source_crs: str = "EPSG:3857") -> dict:
    """Steps in degrees for pixels of ``ground_res_m`` on the ground; by default a Mercator source's own resolution there. Sources in other systems are refused."""
    if source_crs != "EPSG:3857":
        raise ValueError(f"{source_crs}: the source must be EPSG:3857")
    native = source_res_m * math.cos(math.radians(centre_lat))
    ground = ground_res_m or native
    x, y = degree_lengths_m(centre_lat)
    # fixed values: the names of the result
    return {"aoi": aoi, "crs": "EPSG:4326", "centroid_lat": centre_lat, "source_crs": "EPSG:3857", "source_res_m": source_res_m, "native_ground_res_m": native, "ground_res_m": ground, "x_deg": ground / x, "y_deg": ground / y, "resampling": "bilinear"}
