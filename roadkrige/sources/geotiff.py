"""GeoTIFF pixels, a partition per range of tiles or strips, of which a task reads the bytes and no others.

Classic and BigTIFF, either byte order, the first band of 8 to 64 bits; plain,
LZW, deflated or packed bits; horizontal and floating-point differences.  Files
are listed by Spark and opened through Arrow's file systems, so their folder has
to be shared by the executors.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
RANGE_BYTES = 32 << 20
STRIP_BYTES = 4 << 20
CHUNK_PIXELS = 1 << 18
SCHEMA = "path string, row int, col int, x double, y double, value double"
INFO = "path string, width long, height long, x_min double, y_max double, pixel_x double, pixel_y double, nodata double, epsg int, compression int, blocks long"


def unlzw(data: bytes) -> bytes:
    """LZW as TIFF has it: high bits first, 9 to 12 bits, one code early."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out = list(first), []
    held = bits = 0
    width, last = 9, None
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def unpackbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


_DECODERS = {1: bytes, 5: unlzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpackbits}


class Raster:
    """The layout of one file; ``read(at, size)`` gives its bytes."""

    def __init__(self, read):
        self._read = read
        head = read(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        magic = struct.unpack_from(f"{order}H", head, 2)[0] if order else 0
        if magic not in (42, 43):
            raise ValueError("not a TIFF")
        self._order, self._big = order, magic == 43
        at = struct.unpack_from(f"{order}Q", head, 8)[0] if self._big else struct.unpack_from(f"{order}I", head, 4)[0]
        entry, count, start = (f"{order}HHQ", "Q", 8) if self._big else (f"{order}HHI", "H", 2)
        step, room = (20, 8) if self._big else (12, 4)
        (n,) = struct.unpack(order + count, read(at, start))
        directory = read(at + start, n * step)
        self._tags: dict[int, tuple[str, int, int]] = {}
        for i in range(n):
            tag, kind, values = struct.unpack_from(entry, directory, i * step)
            code = _SIZES.get(kind)
            if code is None:
                continue
            place = at + start + i * step + step - room
            if struct.calcsize(order + code) * values > room:
                (place,) = struct.unpack_from(order + ("Q" if self._big else "I"), directory, i * step + step - room)
            self._tags[tag] = (code, values, place)
        self.width, self.height = self._one(256), self._one(257)
        self.compression, self._predictor = self._one(259, 1), self._one(317, 1)
        bits, form = self._one(258, 1), self._one(339, 1)
        if self.compression not in _DECODERS:
            raise ValueError(f"compression {self.compression} is not supported")
        if bits not in (8, 16, 32, 64) or form not in (1, 2, 3) or self._predictor not in (1, 2, 3):
            raise ValueError(f"{bits} bits of sample format {form} with predictor {self._predictor} are not supported")
        self._type = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}")
        self._samples = self._one(277, 1) if self._one(284, 1) == 1 else 1
        self._tiled = 322 in self._tags
        self._tile_w, self._tile_h = (self._one(322), self._one(323)) if self._tiled else (self.width, min(self._one(278, self.height), self.height))
        self._across, down = -(-self.width // self._tile_w), -(-self.height // self._tile_h)
        # rows of a plain strip can be read by themselves
        row_bytes = self._tile_w * self._samples * self._type.itemsize
        self._rows = self._tile_h if self._tiled or self.compression != 1 else max(1, min(self._tile_h, STRIP_BYTES // max(row_bytes, 1)))
        self._parts = -(-self._tile_h // self._rows)
        self.blocks = self._across * down * self._parts
        self.block_bytes = row_bytes * self._rows
        self.x_min, self.y_max, self.pixel_x, self.pixel_y = 0.0, float(self.height), 1.0, 1.0
        if 33550 in self._tags and 33922 in self._tags:
            sx, sy = self._values(33550)[:2]
            i, j, _, x, y, _ = self._values(33922)[:6]
            if self._one(1025, 0, keys=True) == 2:  # a tie point is a pixel's centre
                i, j = i + 0.5, j + 0.5
            self.x_min, self.y_max, self.pixel_x, self.pixel_y = x - i * sx, y + j * sy, sx, sy
        self.nodata = None
        if 42113 in self._tags:
            self.nodata = float(self._values(42113)[0].split(b"\0")[0].strip() or b"nan")
        self.epsg = self._one(3072, 0, keys=True) or self._one(2048, 0, keys=True) or None

    def _values(self, tag: int, first: int = 0, n: int | None = None) -> tuple:
        code, count, place = self._tags[tag]
        if code == "s":
            return (self._read(place, count),)
        n = count - first if n is None else n
        size = struct.calcsize(self._order + code)
        return struct.unpack(self._order + code * n, self._read(place + first * size, n * size))

    def _one(self, tag: int, default: int | None = None, keys: bool = False) -> int:
        if keys:
            at = self._values(34735) if 34735 in self._tags else ()
            return next((at[i + 3] for i in range(4, len(at) - 3, 4) if at[i] == tag and at[i + 1] == 0), default)
        if tag not in self._tags and default is not None:
            return default
        return self._values(tag, 0, 1)[0]

    def block(self, k: int) -> tuple[int, int, np.ndarray]:
        """Top row, left column and pixels (float64, NaN for no data) of block ``k``."""
        whole, part = divmod(k, self._parts)
        y, x = divmod(whole, self._across)
        top, left = y * self._tile_h + part * self._rows, x * self._tile_w
        rows = self._rows if self._tiled else min(self._rows, y * self._tile_h + self._tile_h - top, self.height - top)
        (at,), (size,) = self._values(324 if self._tiled else 273, whole, 1), self._values(325 if self._tiled else 279, whole, 1)
        shape = (max(rows, 0), self._tile_w, self._samples)
        need = shape[0] * shape[1] * shape[2] * self._type.itemsize
        if size == 0:  # left out of the file
            pixels = np.full(shape[:2], np.nan if self.nodata is None else self.nodata)
        else:
            skip = part * self._rows * self._tile_w * self._samples * self._type.itemsize
            raw = self._read(at + skip, need) if self.compression == 1 else _DECODERS[self.compression](self._read(at, size))
            if len(raw) < need:
                raise ValueError(f"block {k} ends after {len(raw)} of {need} bytes")
            pixels = self._undo(raw[:need], shape)[..., 0].astype("f8")
        pixels = pixels[: self.height - top, : self.width - left]
        if self.nodata is not None:
            pixels = np.where(pixels == self.nodata, np.nan, pixels)
        return top, left, pixels

    def _undo(self, raw: bytes, shape: tuple[int, int, int]) -> np.ndarray:
        if self._predictor == 3:  # bytes by significance, differences of bytes along a row
            size = self._type.itemsize
            sums = np.cumsum(np.frombuffer(raw, "u1").reshape(shape[0], -1, shape[2]), axis=1, dtype="u1").reshape(shape[0], size, -1)
            return np.ascontiguousarray(sums.transpose(0, 2, 1)).view(f">f{size}").reshape(shape)
        values = np.frombuffer(raw, self._type).reshape(shape)
        if self._predictor == 2:
            whole = f"u{self._type.itemsize}"
            bits = np.frombuffer(raw, self._type.newbyteorder(self._order).str[0] + whole).reshape(shape).astype(whole)
            return np.cumsum(bits, axis=1, dtype=whole).view(self._type.newbyteorder("=").str[1:])
        return values


def opened(path: str) -> Raster:
    if path.startswith("file:") or path.startswith("/"):
        system, name = fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    else:
        system, name = fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", path), safe=":/@"))
    file = system.open_input_file(name)

    def read(at: int, size: int) -> bytes:
        file.seek(at)
        return file.read(size)

    return Raster(read)


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, ranges: list):
        self._ranges = ranges

    def partitions(self) -> list[InputPartition]:
        # Spark needs one at least
        return [_Range(*r) for r in self._ranges] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        raster = opened(partition.path)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for k in range(partition.first, partition.last):
            top, left, pixels = raster.block(k)
            step = max(1, CHUNK_PIXELS // max(pixels.shape[1], 1))
            for at in range(0, len(pixels), step):
                part = pixels[at : at + step]
                row, col = (a.ravel() for a in np.indices(part.shape, dtype="i4"))
                row, col = row + np.int32(top + at), col + np.int32(left)
                x, y = raster.x_min + (col + 0.5) * raster.pixel_x, raster.y_max - (row + 0.5) * raster.pixel_y
                value = part.ravel()
                columns = [pa.array([partition.path]).take(pa.array(np.zeros(len(row), "i4"))), pa.array(row), pa.array(col), pa.array(x), pa.array(y)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(value, mask=np.isnan(value))], names=names)


class GeoTiff(DataSource):
    """Format ``geotiff``; the option ``ranges`` lists path, first block and the one behind the last."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["ranges"]))


def raster_info(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: size, affine numbers, no-data value, the EPSG code its keys give, blocks.  Only heads are read."""
    files = spark.read.format("binaryFile").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, opened(name)) for name in batch.column(0).to_pylist()]
            names = [c.split() for c in INFO.split(", ")]
            types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array([name if c == "path" else getattr(r, c) for name, r in rows], types[t]) for c, t in names], names=[c for c, _ in names])

    return files.mapInArrow(run, INFO)


def read_geotiff(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, row, col, x and y of the pixel's centre, value (null for no-data).

    A partition is a range of blocks of about ``range_bytes`` of pixels.  A task
    holds one block: a tile, a strip, or up to 4 MB of rows of a plain strip.
    """
    files = spark.read.format("binaryFile").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                raster = opened(name)
                first = np.arange(0, raster.blocks, max(1, range_bytes // max(raster.block_bytes, 1)), dtype="i8")
                last = np.append(first[1:], raster.blocks)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(first), pa.string()), pa.array(first), pa.array(last)], names=["path", "first", "last"])

    # some hundred bytes for 32 MB of pixels
    ranges = [tuple(r) for r in files.mapInArrow(run, "path string, first long, last long").collect()]
    spark.dataSource.register(GeoTiff)
    return spark.read.format("geotiff").option("ranges", json.dumps(sorted(ranges))).load()


def geotiff(band: np.ndarray, x_min: float, y_max: float, pixel: float, nodata: float | None = None, deflate: bool = False, epsg: int | None = None) -> bytes:
    """The bytes of a one-band float64 GeoTIFF in a single strip."""
    raw = np.ascontiguousarray(band, dtype="<f8").tobytes()
    raw = zlib.compress(raw) if deflate else raw
    extra, entries, base = b"", [], 8 + len(raw)

    def add(tag: int, kind: int, *values) -> None:
        nonlocal extra
        data = values[0] if kind == 2 else struct.pack("<" + _SIZES[kind] * len(values), *values)
        count = len(data) if kind == 2 else len(values)
        if len(data) <= 4:
            entries.append(struct.pack("<HHI", tag, kind, count) + data.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", tag, kind, count, base + len(extra)))
            extra += data

    height, width = band.shape
    for tag, kind, *values in ((256, 4, width), (257, 4, height), (258, 3, 64), (259, 3, 8 if deflate else 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, len(raw)),
                               (339, 3, 3), (33550, 12, pixel, pixel, 0.0), (33922, 12, 0.0, 0.0, 0.0, x_min, y_max, 0.0)):
        add(tag, kind, *values)
    if epsg is not None:  # 4000 to 4999: degrees
        add(34735, 3, 1, 1, 0, 2, 1024, 0, 1, 2 if 4000 <= epsg < 5000 else 1, 2048 if 4000 <= epsg < 5000 else 3072, 0, 1, epsg)
    if nodata is not None:
        add(42113, 2, str(nodata).encode() + b"\0")
    return struct.pack("<2sHI", b"II", 42, base + len(extra)) + raw + extra + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0" * 4
