"""GeoTIFF source and sink without native libraries (A1, A2, P4): striped or tiled, uncompressed or deflate, 8/16/32-bit.

``spark.read.format("geotiff_windows")`` gives one row a window of the tile grid, each read by its own task; windows are the
units of ``landgrid.operators.segment.segment_tiles``. Files are read through plain file access where the task runs.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the TIFF and GeoTIFF formats: field sizes by type, and the tags used here.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
WIDTH, LENGTH, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, FORMAT, SCALE, TIE, KEYS = 322, 323, 324, 325, 339, 33550, 33922, 34735


class Tiff:
    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        head = self.file.read(8)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if self.order is None or struct.unpack(self.order + "H", head[2:4])[0] != 42:
            raise ValueError(f"{path} is not a classic TIFF file")
        self.tags = self._directory(struct.unpack(self.order + "I", head[4:8])[0])
        one = lambda t, d: self.tags.get(t, (d,))[0]
        self.width, self.height, self.bands = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
        kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
        self.dtype = np.dtype(f"{self.order}{kind}{one(BITS, 8) // 8}")
        self.compression, self.separate = one(COMPRESSION, 1), one(PLANAR, 1) == 2
        if self.compression not in (1, 8, 32946) or one(PREDICTOR, 1) != 1:
            raise ValueError(f"{path}: compression {self.compression} with predictor {one(PREDICTOR, 1)} is not supported")
        self.tiled = TILE_WIDTH in self.tags
        self.block = (one(TILE_LENGTH, 0), one(TILE_WIDTH, 0)) if self.tiled else (min(one(ROWS, self.height), self.height), self.width)
        self.offsets, self.counts = self.tags[TILE_OFFSETS if self.tiled else OFFSETS], self.tags[TILE_COUNTS if self.tiled else COUNTS]

    def _directory(self, at: int) -> dict[int, tuple]:
        self.file.seek(at)
        n = struct.unpack(self.order + "H", self.file.read(2))[0]
        entries = self.file.read(12 * n)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(self.order + "HHI", entries, 12 * k)
            size = _SIZES.get(kind, 1) * count
            raw = entries[12 * k + 8 : 12 * k + 12]
            if size > 4:
                self.file.seek(struct.unpack(self.order + "I", raw)[0])
                raw = self.file.read(size)
            if kind in _CODES:
                tags[tag] = struct.unpack_from(f"{self.order}{count}{_CODES[kind]}", raw)
        return tags

    @property
    def transform(self) -> tuple[float, ...]:
        sx, sy = self.tags.get(SCALE, (1.0, 1.0))[:2]
        i, j, _, x, y, _ = self.tags.get(TIE, (0.0,) * 6)[:6]
        return sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy

    @property
    def srid(self) -> int | None:
        keys = self.tags.get(KEYS, ())
        found = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4)}
        return found.get(3072) or found.get(2048)

    def window(self, r0: int, r1: int, c0: int, c1: int, bands: int) -> np.ndarray:
        """[bands, rows, columns]; only the blocks that the window meets are read."""
        bh, bw = self.block
        across, down = -(-self.width // bw), -(-self.height // bh)
        out = np.zeros((bands, r1 - r0, c1 - c0), self.dtype)
        for plane in range(bands if self.separate else 1):
            for i in range(r0 // bh, -(-r1 // bh)):
                for j in range(c0 // bw, -(-c1 // bw)):
                    k = plane * across * down + i * across + j
                    self.file.seek(self.offsets[k])
                    raw = self.file.read(self.counts[k])
                    raw = zlib.decompress(raw) if self.compression != 1 else raw
                    depth = 1 if self.separate else self.bands
                    rows = bh if self.tiled else min(bh, self.height - i * bh)
                    data = np.frombuffer(raw, self.dtype, rows * bw * depth).reshape(rows, bw, depth)
                    a0, a1, b0, b1 = max(r0, i * bh), min(r1, i * bh + rows), max(c0, j * bw), min(c1, j * bw + bw)
                    part = data[a0 - i * bh : a1 - i * bh, b0 - j * bw : b1 - j * bw]
                    to = slice(plane, plane + 1) if self.separate else slice(0, bands)
                    out[to, a0 - r0 : a1 - r0, b0 - c0 : b1 - c0] = part[..., : out[to].shape[0]].transpose(2, 0, 1)
        return out


def write_tiff(path: str, data: np.ndarray, transform: tuple[float, ...], srid: int, rows: int = 64) -> None:
    """[bands, rows, columns] as deflated strips with the pixel scale, the upper left corner and the CRS."""
    bands, h, w = data.shape
    pixels = np.ascontiguousarray(data.transpose(1, 2, 0)).astype(data.dtype.newbyteorder("<"))
    strips = [zlib.compress(pixels[i : i + rows].tobytes()) for i in range(0, h, rows)]
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s) + len(s) % 2
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    entries = [(WIDTH, 4, (w,)), (LENGTH, 4, (h,)), (BITS, 3, (data.dtype.itemsize * 8,) * bands), (COMPRESSION, 3, (8,)), (262, 3, (2 if bands == 3 else 1,)), (OFFSETS, 4, tuple(offsets)), (SAMPLES, 3, (bands,)), (ROWS, 4, (rows,)), (COUNTS, 4, tuple(map(len, strips))), (PLANAR, 3, (1,)), (FORMAT, 3, (kind,) * bands), (SCALE, 12, (abs(transform[0]), abs(transform[4]), 0.0)), (TIE, 12, (0.0, 0.0, 0.0, transform[2], transform[5], 0.0)), (KEYS, 3, (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, srid))]
    extra, body = b"", b""
    start = at + 2 + 12 * len(entries) + 4
    for tag, code, values in entries:
        raw = struct.pack(f"<{len(values)}{_CODES[code]}", *values)
        if len(raw) > 4:
            place = struct.pack("<I", start + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            place = raw.ljust(4, b"\0")
        body += struct.pack("<HHI", tag, code, len(values)) + place
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", at))
        for s in strips:
            f.write(s + b"\0" * (len(s) % 2))
        f.write(struct.pack("<H", len(entries)) + body + b"\0\0\0\0" + extra)


class _Window(InputPartition):
    def __init__(self, tile_no: int, r0: int, r1: int, c0: int, c1: int):
        self.tile_no, self.at = tile_no, (r0, r1, c0, c1)


class _Reader(DataSourceReader):
    def __init__(self, path: str, tile: int, overlap: int, bands: int):
        self.path, self.tile, self.overlap, self.bands = path, tile, overlap, bands

    def partitions(self):
        t = Tiff(self.path)
        out = []
        for i in range(0, t.height, self.tile):
            for j in range(0, t.width, self.tile):
                out.append(_Window(len(out), max(0, i - self.overlap), min(t.height, i + self.tile + self.overlap), max(0, j - self.overlap), min(t.width, j + self.tile + self.overlap)))
        return out

    def read(self, partition):
        t = Tiff(self.path)
        n = min(self.bands, t.bands)
        x = t.window(*partition.at, n)
        r0, _, c0, _ = partition.at
        yield (partition.tile_no, r0, c0, x.shape[1], x.shape[2], n, t.dtype.newbyteorder("<").str, x.astype(t.dtype.newbyteorder("<")).tobytes())


class GeoTiffWindows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff_windows"

    def schema(self) -> str:
        return "tile_no long, row_start int, col_start int, h int, w int, bands int, dtype string, data binary"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Reader(o["path"], int(o.get("tile", 512)), int(o.get("overlap", 64)), int(o.get("bands", 3)))


def read_windows(spark: SparkSession, path: str, tile: int = 512, overlap: int = 64, bands: int = 3) -> DataFrame:
    """A missing raster is an error before anything runs."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    spark.dataSource.register(GeoTiffWindows)
    return spark.read.format("geotiff_windows").option("tile", tile).option("overlap", overlap).option("bands", bands).load(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A1: one row: width, height, srid, a to f, bands, dtype."""
    t = Tiff(path)
    return spark.createDataFrame([(t.width, t.height, t.srid, *map(float, t.transform), t.bands, t.dtype.name)], "width int, height int, srid int, a double, b double, c double, d double, e double, f double, bands int, dtype string")
