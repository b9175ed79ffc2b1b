"""Polygons of a GeoPackage: a SQLite file whose geometries are well-known binary behind a short header. Read on the driver; outlines are small."""

from __future__ import annotations

import sqlite3
import struct

from cellmosaic.functions.geom import Ring

# fixed values: bytes of a header's envelope by its code; geometry kinds
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
POLYGON, MULTI_POLYGON = 3, 6


def rings_from_wkb(data: bytes, at: int = 0) -> tuple[list[Ring], int]:
    """All rings of a polygon or multipolygon from ``at`` on, and where it ends. Heights and measures are passed over."""
    order = "<" if data[at] else ">"
    (kind,) = struct.unpack_from(order + "I", data, at + 1)
    extra = 2 * bool(kind & 0xC0000000 == 0xC0000000) or bool(kind & 0xC0000000) or {0: 0, 1: 1, 2: 1, 3: 2}[kind % 65536 // 1000]
    wide, kind = 2 + int(extra), kind % 65536 % 1000
    (n,) = struct.unpack_from(order + "I", data, at + 5)
    at += 9
    found: list[Ring] = []
    for _ in range(n):
        if kind == MULTI_POLYGON:
            more, at = rings_from_wkb(data, at)
            found += more
        elif kind == POLYGON:
            (points,) = struct.unpack_from(order + "I", data, at)
            flat = struct.unpack_from(f"{order}{points * wide}d", data, at + 4)
            found.append([(flat[k], flat[k + 1]) for k in range(0, len(flat), wide)])
            at += 4 + 8 * points * wide
        else:
            raise ValueError(f"geometry kind {kind}: only polygons")
    return found, at


def layers(path: str) -> list[tuple[str, str]]:
    """Tables with geometries, and the column that has them."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        return con.execute("select table_name, column_name from gpkg_geometry_columns order by 1").fetchall()


def read_geopackage(path: str, layer: str | None = None, column: str | None = None, prefix: str | None = None) -> list[Ring]:
    """All rings of a layer (the first one by default); with ``column`` and ``prefix``, of the rows whose text begins so."""
    names = dict(layers(path))
    table = layer or next(iter(names))
    where, given = ("", ()) if column is None else (f' where substr("{column}", 1, ?) = ?', (len(prefix or ""), prefix or ""))
    found: list[Ring] = []
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        for (blob,) in con.execute(f'select "{names[table]}" from "{table}"{where}', given):
            if blob and not blob[3] & 0x10:  # not an empty geometry
                found += rings_from_wkb(bytes(blob), 8 + ENVELOPE[blob[3] >> 1 & 7])[0]
    return found
