"""GeoTIFF rasters as tables: a Python data source that reads windows of files, and a writer of tiled files with overviews.

Read: ``spark.read.format("geotiff").load(paths)`` gives a row a pixel, ``tile, r, c, lon, lat`` and a column a band. A partition is a window of ``size`` by ``size`` pixels, of which only the
file's blocks that it touches are read. Write: each block of pixels is encoded by the task that has it; only encoded blocks meet in one task a file.

Files are little-endian classic or big TIFF, in tiles or strips, bands side by side or one after another; uncompressed, deflate or Zstandard; predictor 1 or 2. Paths are those that
``pyarrow.fs`` opens.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cellmosaic.sources.store import scratch

# fixed values: the format's tags, types (code: struct letter), compressions and coordinate keys
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
SUBFILE, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 254, 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
NONE, DEFLATE, OLD_DEFLATE, ZSTD = 1, 8, 32946, 50000
MODEL_TYPE_KEY, RASTER_TYPE_KEY, GEOGRAPHIC_KEY, PROJECTED_KEY = 1024, 1025, 2048, 3072

Read = Callable[[int, int], bytes]


@dataclass
class GeoTiff:
    """The first image of a file; ``read(offset, length)`` reads bytes of it."""

    read: Read
    tags: dict[int, tuple] = field(default_factory=dict)

    def __post_init__(self) -> None:
        head = self.read(0, 16)
        if head[:2] != b"II" or head[2] not in (42, 43):
            raise ValueError("no little-endian TIFF")
        self.big = head[2] == 43
        (at,) = struct.unpack_from("<Q" if self.big else "<I", head, 8 if self.big else 4)
        entry, count = (20, "<Q") if self.big else (12, "<H")
        (n,) = struct.unpack(count, self.read(at, struct.calcsize(count)))
        body = self.read(at + struct.calcsize(count), n * entry)
        for k in range(n):
            tag, kind, size = struct.unpack_from("<HHQ" if self.big else "<HHI", body, k * entry)
            if kind not in TYPES:
                continue
            letters, room = TYPES[kind], 8 if self.big else 4
            length = struct.calcsize("<" + letters) * size
            raw = body[(k + 1) * entry - room : (k + 1) * entry]
            if length > room:
                raw = self.read(struct.unpack("<Q" if self.big else "<I", raw)[0], length)
            self.tags[tag] = (raw[:length],) if letters == "s" else struct.unpack(f"<{letters * size}", raw[:length])
        one = lambda tag, default=None: self.tags.get(tag, (default,))[0]
        self.width, self.height, self.bands = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        self.dtype = np.dtype(f"<{ {1: 'u', 2: 'i', 3: 'f'}[one(SAMPLE_FORMAT, 1)] }{one(BITS, 1) // 8}")
        self.compression, self.predictor, self.separate = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2
        if self.compression not in (NONE, DEFLATE, OLD_DEFLATE, ZSTD) or self.predictor not in (1, 2):
            raise ValueError(f"compression {self.compression}, predictor {self.predictor}")
        tiled = TILE_OFFSETS in self.tags
        self.block = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, self.height), self.height), self.width)
        self.offsets, self.counts = self.tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], self.tags[TILE_COUNTS if tiled else STRIP_COUNTS]
        self.across, self.down = -(-self.width // self.block[1]), -(-self.height // self.block[0])
        scale, tie = self.tags.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), self.tags.get(TIE_POINT, (0.0,) * 6)
        self.step = (scale[0], -scale[1])
        self.origin = (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1])
        keys = self.tags.get(GEO_KEYS, ())
        found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
        self.epsg = found.get(PROJECTED_KEY) or found.get(GEOGRAPHIC_KEY)
        text = one(NODATA)
        self.nodata = float(text.rstrip(b"\0 ").decode()) if text and text.rstrip(b"\0 ") else None

    def _decoded(self, number: int) -> np.ndarray:
        """One block, bands last (a single band where they stand one after another)."""
        bands = 1 if self.separate else self.bands
        rows = self.block[0]
        if TILE_OFFSETS not in self.tags:  # the last strip is as high as what is left
            rows = min(rows, self.height - number % self.down * rows)
        shape = (rows, self.block[1], bands)
        if not self.counts[number]:
            return np.full(shape, self.nodata or 0, self.dtype)
        data = self.read(self.offsets[number], self.counts[number])
        size = int(np.prod(shape)) * self.dtype.itemsize
        if self.compression == ZSTD:
            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
        elif self.compression != NONE:
            data = zlib.decompress(data)
        out = np.frombuffer(data, self.dtype, int(np.prod(shape))).reshape(shape)
        return np.cumsum(out, axis=1, dtype=self.dtype) if self.predictor == 2 else out

    def window(self, row: int, col: int, height: int, width: int) -> np.ndarray:
        """``[band, r, c]`` of a window inside the image."""
        out = np.zeros((self.bands, height, width), self.dtype)
        for i in range(row // self.block[0], (row + height - 1) // self.block[0] + 1):
            for j in range(col // self.block[1], (col + width - 1) // self.block[1] + 1):
                for band in range(self.bands if self.separate else 1):
                    part = self._decoded((band * self.down + i) * self.across + j)
                    top, left = i * self.block[0], j * self.block[1]
                    r0, c0 = max(row, top), max(col, left)
                    r1, c1 = min(row + height, top + part.shape[0]), min(col + width, left + part.shape[1])
                    cut = part[r0 - top : r1 - top, c0 - left : c1 - left].transpose(2, 0, 1)
                    to = slice(band, band + 1) if self.separate else slice(None)
                    out[to, r0 - row : r1 - row, c0 - col : c1 - col] = cut
        return out

    def bounds(self) -> tuple[float, float, float, float]:
        """West, south, east, north."""
        return self.origin[0], self.origin[1] + self.height * self.step[1], self.origin[0] + self.width * self.step[0], self.origin[1]


def open_geotiff(path: str) -> GeoTiff:
    fs, local = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    f = fs.open_input_file(local)
    return GeoTiff(lambda at, n: f.read_at(n, at))


def readable(path: str) -> bool:
    """Whether every block of every band can be decoded: a file that was cut off is not."""
    try:
        tiff = open_geotiff(path)
        for number in range(len(tiff.offsets)):
            tiff._decoded(number)
        return True
    except Exception:  # whatever a damaged file brings about
        return False


@dataclass
class _Window(InputPartition):
    path: str
    row: int
    col: int
    height: int
    width: int


def _kind(dtype: np.dtype) -> str:
    return "double" if dtype.kind == "f" else "long" if dtype.itemsize > 4 or dtype == np.dtype("<u4") else "int"


class GeoTiffSource(DataSource):
    """Options: ``path`` (several with commas), ``size`` of windows (1024), ``bands``: columns' names with commas (``band1``...)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def _paths(self) -> list[str]:
        out: list[str] = []
        for path in self.options["path"].split(","):
            fs, local = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)
            if fs.get_file_info(local).type == pafs.FileType.Directory:
                out += sorted(f"{path.rstrip('/')}/{x.base_name}" for x in fs.get_file_info(pafs.FileSelector(local)) if x.base_name.lower().endswith((".tif", ".tiff")))
            else:
                out.append(path)
        if not out:
            raise ValueError(f"no GeoTIFF in {self.options['path']}")
        return out

    def schema(self) -> str:
        first = open_geotiff(self._paths()[0])
        names = self.options.get("bands", ",".join(f"band{k + 1}" for k in range(first.bands))).split(",")
        if len(names) != first.bands:
            raise ValueError(f"{len(names)} names for {first.bands} bands")
        return ", ".join(["tile string, r long, c long, lon double, lat double", *(f"`{n}` {_kind(first.dtype)}" for n in names)])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._paths(), int(self.options.get("size", "1024")), schema)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], size: int, schema):
        self.paths, self.size, self.schema = paths, size, schema

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for path in self.paths:
            t = open_geotiff(path)
            for row in range(0, t.height, self.size):
                for col in range(0, t.width, self.size):
                    found.append(_Window(path, row, col, min(self.size, t.height - row), min(self.size, t.width - col)))
        return found

    def read(self, partition: _Window) -> Iterator[pa.RecordBatch]:
        t, p = open_geotiff(partition.path), partition
        tile = p.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        step = max(1, (1 << 17) // p.width)
        for row in range(p.row, p.row + p.height, step):
            data = t.window(row, p.col, min(step, p.row + p.height - row), p.width)
            r, c = (x.ravel() for x in np.mgrid[row : row + data.shape[1], p.col : p.col + p.width])
            lon, lat = t.origin[0] + (c + 0.5) * t.step[0], t.origin[1] + (r + 0.5) * t.step[1]
            cols = [pa.array([tile] * len(r)), pa.array(r.astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(lon), pa.array(lat)]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(b.ravel()).cast(kinds[_kind(t.dtype)]) for b in data)], self.schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiffSource)


def read_geotiff(spark: SparkSession, *paths: str, bands: tuple[str, ...] | None = None, size: int = 1024) -> DataFrame:
    """A row a pixel of all files."""
    register(spark)
    reader = spark.read.format("geotiff").option("size", size)
    return (reader.option("bands", ",".join(bands)) if bands else reader).load(",".join(paths))


def encode(bands: np.ndarray, origin: tuple[float, float], step: tuple[float, float], epsg: int = 4326, nodata: int = 0, block: int = 512, overviews: int = 0, big: bool | None = None) -> bytes:
    """A whole file from an array ``[band, r, c]``: for small rasters and tests."""
    levels = [bands[:, :: 1 << k, :: 1 << k] for k in range(overviews + 1)]
    blocks = {}
    for k, level in enumerate(levels):
        for i in range(-(-level.shape[1] // block)):
            for j in range(-(-level.shape[2] // block)):
                blocks[k, i, j] = _encode_block(level[:, i * block : (i + 1) * block, j * block : (j + 1) * block], nodata, block)
    return _assemble(blocks, [x.shape[1:] for x in levels], len(bands), bands.dtype, origin, step, epsg, nodata, block, big)


def _encode_block(part: np.ndarray, nodata: int, block: int) -> bytes:
    if (part == nodata).all():
        return b""  # a block of no bytes is all nodata
    whole = np.full((block, block, len(part)), nodata, part.dtype)
    whole[: part.shape[1], : part.shape[2]] = part.transpose(1, 2, 0)
    return zstandard.ZstdCompressor(level=3).compress(whole.astype(part.dtype.newbyteorder("<")).tobytes())


def _assemble(blocks: dict, shapes: list[tuple[int, int]], bands: int, dtype: np.dtype, origin, step, epsg: int, nodata: int, block: int, big: bool | None = None) -> bytes:
    """All directories first, the full image's before those of smaller ones; then blocks, those of the smallest one first."""
    big = sum(map(len, blocks.values())) > 3 << 30 if big is None else big
    word, kind, room, entry, count = ("Q", 16, 8, 20, "<Q") if big else ("I", 4, 4, 12, "<H")
    geo = (1, 1, 0, 3, MODEL_TYPE_KEY, 0, 1, 1 if epsg == 3857 else 2, RASTER_TYPE_KEY, 0, 1, 1, PROJECTED_KEY if epsg == 3857 else GEOGRAPHIC_KEY, 0, 1, epsg)
    order = [(i, j) for i in range(-(-shapes[0][0] // block)) for j in range(-(-shapes[0][1] // block))]
    grids = [[(i, j) for i in range(-(-h // block)) for j in range(-(-w // block))] for h, w in shapes]
    assert grids[0] == order

    def entries(k: int, offsets: list[int]) -> list[tuple[int, int, tuple]]:
        h, w = shapes[k]
        text = f"{nodata}\0".encode()
        code = {"u": 1, "i": 2, "f": 3}[dtype.kind]
        out = [
            (SUBFILE, 4, (int(k > 0),)), (WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (dtype.itemsize * 8,) * bands), (COMPRESSION, 3, (ZSTD,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (bands,)), (PLANAR, 3, (1,)),
            (TILE_WIDTH, 3, (block,)), (TILE_HEIGHT, 3, (block,)), (TILE_OFFSETS, kind, tuple(offsets)), (TILE_COUNTS, 4, tuple(len(blocks.get((k, i, j), b"")) for i, j in grids[k])), (SAMPLE_FORMAT, 3, (code,) * bands),
        ]
        if not k:
            out += [(PIXEL_SCALE, 12, (step[0], -step[1], 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, origin[0], origin[1], 0.0)), (GEO_KEYS, 3, geo)]
        return [*out, (NODATA, 2, (text,))]

    def directories(places: list[list[int]]) -> bytes:
        at, parts = 16 if big else 8, []
        for k in range(len(shapes)):
            rows = entries(k, places[k])
            tail_at, heads, tail = at + struct.calcsize(count) + entry * len(rows) + room, b"", b""
            for tag, code, values in rows:
                raw = values[0] if code == 2 else struct.pack(f"<{TYPES[code] * len(values)}", *values)
                if len(raw) > room:
                    place = struct.pack("<" + word, tail_at + len(tail))
                    tail += raw + b"\0" * (len(raw) % 2)
                else:
                    place = raw.ljust(room, b"\0")
                heads += struct.pack("<HH" + word, tag, code, len(raw) if code == 2 else len(values)) + place
            at = tail_at + len(tail)
            parts.append(struct.pack(count, len(rows)) + heads + struct.pack("<" + word, at if k + 1 < len(shapes) else 0) + tail)
        return (struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)) + b"".join(parts)

    at = len(directories([[0] * len(g) for g in grids]))
    places, data = [[0] * len(g) for g in grids], []
    for k in reversed(range(len(shapes))):
        for n, (i, j) in enumerate(grids[k]):
            own = blocks.get((k, i, j), b"")
            if own:
                places[k][n] = at
                data.append(own)
                at += len(own)
    return directories(places) + b"".join(data)


def write_geotiff(
    pixels: DataFrame, folder: str, shape: tuple[int, int], bands: tuple[str, ...], origins: dict[str, tuple[float, float]], step: tuple[float, float], dtype: str = "uint8", epsg: int = 4326, nodata: int = 0, block: int = 512,
    overviews: int = 3,
) -> DataFrame:
    """Writes, now, ``<folder>/<tile>.tif`` for each tile of ``tile, r, c`` and bands, all of one ``shape``; gives ``tile, path, bytes``. ``origins``: each tile's north-west corner.

    Pixels that are missing are ``nodata``; of two rows for one pixel, the one with the larger values stays. A tile without pixels gets no file. An overview has every second pixel of the level below.
    """
    kind = np.dtype(dtype)
    shapes = [(-(-shape[0] // (1 << k)), -(-shape[1] // (1 << k))) for k in range(overviews + 1)]
    rows = pixels.groupBy("tile", "r", "c").agg(F.max(F.struct(*bands)).alias("_v")).select("tile", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "_v.*")
    levels = None
    for k in range(overviews + 1):
        own = rows.filter((F.col("r") % (1 << k) == 0) & (F.col("c") % (1 << k) == 0)).withColumns({"r": F.shiftright("r", k), "c": F.shiftright("c", k), "level": F.lit(k)})
        levels = own if levels is None else levels.unionByName(own)
    keyed = levels.withColumns({"i": F.floor(F.col("r") / block).cast("int"), "j": F.floor(F.col("c") / block).cast("int")})

    def pack(table: pa.Table) -> pa.Table:
        part = np.full((len(bands), block, block), nodata, kind)
        r, c = table.column("r").to_numpy() % block, table.column("c").to_numpy() % block
        for n, b in enumerate(bands):
            part[n, r, c] = table.column(b).to_numpy().astype(kind)
        return pa.table([table.column(x).slice(0, 1) for x in ("tile", "level", "i", "j")] + [pa.array([_encode_block(part, nodata, block)], pa.binary())], ["tile", "level", "i", "j", "data"])

    def put(table: pa.Table) -> pa.Table:
        tile = table.column("tile")[0].as_py()
        found = {(x["level"], x["i"], x["j"]): x["data"] for x in table.select(["level", "i", "j", "data"]).to_pylist()}
        data = _assemble(found, shapes, len(bands), kind, origins[tile], step, epsg, nodata, block)
        fs, top = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        fs.create_dir(top, recursive=True)
        part = f"{top}/.{tile}.{zlib.crc32(data):08x}.part"
        with fs.open_output_stream(part, compression=None) as f:
            f.write(data)
        fs.move(part, f"{top}/{tile}.tif")  # whole or not at all
        return pa.table([pa.array([tile]), pa.array([f"{folder}/{tile}.tif"]), pa.array([len(data)])], ["tile", "path", "bytes"])

    packed = keyed.groupBy("tile", "level", "i", "j").applyInArrow(pack, "tile string, level int, i int, j int, data binary")
    spark, done = pixels.sparkSession, scratch(pixels.sparkSession, "geotiffs")
    packed.groupBy("tile").applyInArrow(put, "tile string, path string, bytes long").write.parquet(done)
    return spark.read.parquet(done)
