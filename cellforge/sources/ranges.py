"""Raster files read by byte ranges: tiled images and time series of records.

A Python data source plans, from a file's header alone, which ranges of bytes hold what a query asks for, and each task reads and
decodes a few of them. Bounds on rows, columns, years and variables come as options or, where Spark is set to push filters to
Python sources (``spark.sql.python.filterPushdown.enabled``), from the query's own conditions. Files must be reachable by path from the driver and
from every executor.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

# Fixed values of the image format: tags, sizes of field types, compressions, predictors.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT, NODATA = 322, 323, 324, 325, 339, 42113
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
#: Tiles that one task reads.
TOGETHER = 16
#: Values that one task reads of a record.
VALUES = 1 << 22


def paths_of(path: str) -> list[str]:
    """The files that a path or pattern names."""
    return sorted(p for p in glob.glob(os.path.join(path, "*") if os.path.isdir(path) else path) if os.path.isfile(p))


@dataclass
class Image:
    """The header of a single-band tiled (or striped) image of the common tagged format, plain or with 64-bit offsets."""

    path: str
    order: str
    tags: dict[int, tuple] = field(repr=False)

    @classmethod
    def open(cls, path: str) -> Image:
        with open(path, "rb") as f:
            head = f.read(16)
            order = {b"II": "<", b"MM": ">"}.get(head[:2])
            kind = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
            if kind not in (42, 43):
                raise ValueError(f"{path} is no tagged image")
            large = kind == 43
            at = struct.unpack(f"{order}Q", head[8:16])[0] if large else struct.unpack(f"{order}I", head[4:8])[0]
            f.seek(at)
            n = struct.unpack(f"{order}Q", f.read(8))[0] if large else struct.unpack(f"{order}H", f.read(2))[0]
            size, inline = (20, 8) if large else (12, 4)
            tags = {}
            for entry in struct.iter_unpack(f"{size}s", f.read(n * size)):
                tag, kind, count = struct.unpack_from(f"{order}HH{'Q' if large else 'I'}", entry[0])
                if kind not in FIELDS:
                    continue
                form = f"{order}{count}{FIELDS[kind]}"
                data = entry[0][-inline:]
                if struct.calcsize(form) > inline:
                    f.seek(struct.unpack(f"{order}{'Q' if large else 'I'}", data)[0])
                    data = f.read(struct.calcsize(form))
                tags[tag] = struct.unpack_from(form, data)
        image = cls(path, order, tags)
        if image.one(SAMPLES, 1) != 1:
            raise ValueError(f"{path} has several bands")
        return image

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def shape(self) -> tuple[int, int]:
        return self.one(HEIGHT), self.one(WIDTH)

    @property
    def tile(self) -> tuple[int, int]:
        return (self.one(TILE_HEIGHT), self.one(TILE_WIDTH)) if TILES in self.tags else (min(self.one(STRIP_ROWS, self.shape[0]), self.shape[0]), self.shape[1])

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"{self.order}{'uif'[self.one(SAMPLE_FORMAT, 1) - 1]}{self.one(BITS, 8) // 8}")

    @property
    def nodata(self) -> float | None:
        text = self.one(NODATA, b"").rstrip(b"\0 ").decode()
        return float(text) if text else None

    def ranges(self, r0: int, r1: int, c0: int, c1: int) -> list[tuple[int, int, int, int]]:
        """(row, column, offset, bytes) of the tiles that rows r0 to r1 and columns c0 to c1 meet."""
        (height, width), (th, tw) = self.shape, self.tile
        across = -(-width // tw)
        at, size = (self.tags[TILES], self.tags[TILE_BYTES]) if TILES in self.tags else (self.tags[STRIPS], self.tags[STRIP_BYTES])
        rows = range(max(0, r0) // th, min(r1, height - 1) // th + 1) if r0 < height and r1 >= 0 else ()
        columns = range(max(0, c0) // tw, min(c1, width - 1) // tw + 1) if c0 < width and c1 >= 0 else ()
        return [(i * th, j * tw, at[i * across + j], size[i * across + j]) for i in rows for j in columns if size[i * across + j]]

    def decoded(self, data: bytes) -> np.ndarray:
        """A tile's values; a last strip may have fewer rows."""
        how, predictor, (_, tw) = self.one(COMPRESSION, 1), self.one(PREDICTOR, 1), self.tile
        if how in (DEFLATE, OLD_DEFLATE):
            data = zlib.decompress(data)
        elif how == LZW:
            data = unpacked(data)
        elif how != PLAIN:
            raise ValueError(f"{self.path} has the unknown compression {how}")
        kind = self.dtype
        if predictor == 3:  # bytes of each row as differences, the highest bytes of all values first
            x = np.cumsum(np.frombuffer(data, np.uint8).reshape(-1, tw * kind.itemsize), axis=1, dtype=np.uint8)
            return np.ascontiguousarray(x.reshape(-1, kind.itemsize, tw).transpose(0, 2, 1)).view(kind.newbyteorder(">"))[:, :, 0]
        x = np.frombuffer(data, kind).reshape(-1, tw)
        return np.cumsum(x, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else x


def unpacked(data: bytes) -> bytes:
    """LZW codes of 9 to 12 bits, the highest bit first, whose width grows one code early."""
    clear, end = 256, 257
    out, table, width, held, n, before = [], [], 9, 0, 0, b""
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        n += 8
        if n < width:
            continue
        n -= width
        code = held >> n & (1 << width) - 1
        if code == end:
            break
        if code == clear:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out.append(entry)
        if before:
            table.append(before + entry[:1])
        before = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


@dataclass
class Bounds:
    """Least and most values of columns, and values that they must be among, from options and pushed conditions."""

    least: dict[str, float] = field(default_factory=dict)
    most: dict[str, float] = field(default_factory=dict)
    among: dict[str, set] = field(default_factory=dict)

    def add(self, condition, columns: Sequence[str]) -> bool:
        """Takes in a condition on one of ``columns``; False if it is of another kind. Spark still tests it."""
        name = ".".join(getattr(condition, "attribute", ()))
        if name not in columns:
            return False
        if isinstance(condition, EqualTo):
            self.only(name, {condition.value})
        elif isinstance(condition, In):
            self.only(name, set(condition.value))
        elif isinstance(condition, (GreaterThan, GreaterThanOrEqual)):
            self.least[name] = max(self.least.get(name, condition.value), condition.value)
        elif isinstance(condition, (LessThan, LessThanOrEqual)):
            self.most[name] = min(self.most.get(name, condition.value), condition.value)
        else:
            return False
        return True

    def only(self, name: str, values: set) -> None:
        self.among[name] = self.among[name] & values if name in self.among else values

    def span(self, name: str, size: int) -> tuple[int, int]:
        """The first and last whole number from 0 to ``size`` - 1 that may be asked for; the last is before the first if there is none."""
        values = self.among.get(name)
        low, high = (0, size - 1) if values is None else (min(values, default=0), max(values, default=-1))
        return int(np.ceil(max(low, self.least.get(name, 0), 0))), int(np.floor(min(high, self.most.get(name, size - 1), size - 1)))

    def allows(self, name: str, value) -> bool:
        return (name not in self.among or value in self.among[name]) and (name not in self.least or value >= self.least[name]) and (name not in self.most or value <= self.most[name])


class _Reader(DataSourceReader):
    columns: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.options, self.bounds = options, Bounds()
        for n in self.columns:
            if f"least_{n}" in options:
                self.bounds.least[n] = float(options[f"least_{n}"])
            if f"most_{n}" in options:
                self.bounds.most[n] = float(options[f"most_{n}"])

    @classmethod
    def made(cls, options: dict) -> DataSourceReader:
        """A reader that takes conditions from Spark only where Spark is set to push them; others may not offer to."""
        return (type(f"Pushed{cls.__name__}", (_Pushed, cls), {}) if options.get("push", "false") == "true" else cls)(options)


class _Pushed:
    def pushFilters(self, filters):
        for f in filters:
            self.bounds.add(f, self.columns)
            yield f  # bounds are those of whole tiles or records, so Spark tests each row


def reader_of(spark: SparkSession, source: type[DataSource]) -> DataFrameReader:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))


def batch(columns: Sequence[np.ndarray | pa.Array], names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], list(names))


class TileReader(_Reader):
    columns = ("r", "c")

    def partitions(self) -> list[InputPartition]:
        parts = []
        for path in paths_of(self.options["path"]):
            image = Image.open(path)
            found = image.ranges(*self.bounds.span("r", image.shape[0]), *self.bounds.span("c", image.shape[1]))
            parts += [InputPartition((path, found[k : k + TOGETHER])) for k in range(0, len(found), TOGETHER)]
        return parts or [InputPartition(("", []))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, ranges = partition.value
        if not ranges:
            return
        image = Image.open(path)
        (height, width), nodata = image.shape, image.nodata
        with open(path, "rb") as f:
            for r0, c0, at, size in ranges:
                f.seek(at)
                x = image.decoded(f.read(size))[: height - r0, : width - c0]
                r, c = np.divmod(np.arange(x.size, dtype=np.int32), np.int32(x.shape[1]))
                v = x.astype(float).ravel()
                lacks = np.isnan(v) if nodata is None else np.isnan(v) | (v == nodata)
                yield batch([pa.array([path] * x.size), r + np.int32(r0), c + np.int32(c0), pa.array(v, mask=lacks)], ["path", "r", "c", "value"])


class TiledImages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiled_images"

    def schema(self) -> str:
        return "path string, r int, c int, value double"

    def reader(self, schema) -> DataSourceReader:
        return TileReader.made(self.options)


def read_tiles(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(path, r, c, value) of single-band tiled or striped images that ``path`` names: a file, folder or pattern.

    With a ``window`` (first row, first column, rows, columns) only the tiles that it meets are read, and only its cells come. Whole numbers of 8 to 64 bits and floats, plain, LZW or deflate,
    with differences of values or of bytes. The mark of no data and NaN are null; tiles that are left out of a file have no rows.
    """
    reader = reader_of(spark, TiledImages)
    if window is None:
        return reader.load(path)
    r0, c0, rows, columns = window
    reader = reader.options(least_r=r0, most_r=r0 + rows - 1, least_c=c0, most_c=c0 + columns - 1)
    return reader.load(path).where(f"r BETWEEN {r0} AND {r0 + rows - 1} AND c BETWEEN {c0} AND {c0 + columns - 1}")


# Fixed values of the classic time-series format: types of values, tags of the header's lists.
KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12


@dataclass
class Variable:
    name: str
    shape: tuple[int, ...]
    dtype: str
    begin: int
    recorded: bool
    fill: float | None

    @property
    def size(self) -> int:
        """Bytes of one record, or of the whole."""
        return int(np.prod(self.shape, dtype=np.int64)) * np.dtype(self.dtype).itemsize


@dataclass
class Series:
    """The header of a file of the classic format: variables, and how far a record is from the next."""

    variables: list[Variable]
    records: int
    stride: int

    @classmethod
    def open(cls, path: str) -> Series:
        with open(path, "rb") as f:
            magic = f.read(4)
            if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
                raise ValueError(f"{path} is no classic series of records")
            version = magic[3]
            number = lambda: struct.unpack(">Q", f.read(8))[0] if version == 5 else struct.unpack(">I", f.read(4))[0]

            def name() -> str:
                n = number()
                return f.read(-(-n // 4) * 4)[:n].decode()

            def listed(tag: int) -> int:
                found, n = struct.unpack(">I", f.read(4))[0], number()
                if found not in (0, tag):
                    raise ValueError(f"{path} has a broken header")
                return n

            def attributes() -> dict:
                out = {}
                for _ in range(listed(ATTRIBUTES)):
                    own, kind, n = name(), np.dtype(KINDS[struct.unpack(">I", f.read(4))[0]]), number()
                    out[own] = np.frombuffer(f.read(-(-n * kind.itemsize // 4) * 4)[: n * kind.itemsize], kind)
                return out

            records = number()
            dims = [(name(), number()) for _ in range(listed(DIMENSIONS))]
            attributes()
            found = []
            for _ in range(listed(VARIABLES)):
                own = name()
                ids = [number() for _ in range(number())]
                more = attributes()
                kind = KINDS[struct.unpack(">I", f.read(4))[0]]
                number()
                begin = struct.unpack(">I" if version == 1 else ">Q", f.read(4 if version == 1 else 8))[0]
                recorded = bool(ids) and dims[ids[0]][1] == 0
                fill = next((float(more[n][0]) for n in ("_FillValue", "missing_value") if n in more and more[n].dtype.kind != "S"), None)
                found.append(Variable(own, tuple(dims[i][1] for i in ids[recorded:]), kind, begin, recorded, fill))
        sizes = [v.size for v in found if v.recorded]
        stride = sizes[0] if len(sizes) == 1 else sum(-(-s // 4) * 4 for s in sizes)
        if sizes and records == (2**64 - 1 if version == 5 else 2**32 - 1):  # still being written
            records = (os.path.getsize(path) - min(v.begin for v in found if v.recorded)) // stride
        return cls(found, records, stride)


class RecordReader(_Reader):
    columns = ("t", "variable")

    def partitions(self) -> list[InputPartition]:
        parts = []
        for path in paths_of(self.options["path"]):
            series = Series.open(path)
            t0, t1 = self.bounds.span("t", series.records)
            for v in series.variables:
                if not v.recorded or len(v.shape) != 2 or not self.bounds.allows("variable", v.name):
                    continue
                height, width = v.shape
                step = max(1, VALUES // max(1, width))
                for t in range(t0, t1 + 1):
                    if self.bounds.allows("t", t):
                        start = v.begin + t * series.stride
                        parts += [InputPartition((path, v.name, v.shape, v.dtype, v.fill, t, start + r * width * np.dtype(v.dtype).itemsize, r, min(step, height - r))) for r in range(0, height, step)]
        return parts or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, name, (height, width), dtype, fill, t, at, first, rows = partition.value
        x = values(path, at, rows * width, dtype).astype(float)
        r, c = np.divmod(np.arange(x.size, dtype=np.int32), np.int32(width))
        r += np.int32(first)
        if self.options.get("flip", "false") == "true":
            r = np.int32(height - 1) - r
        lacks = np.isnan(x) if fill is None else np.isnan(x) | (x == fill)
        yield batch([pa.array(np.full(x.size, t, np.int32)), pa.array([name] * x.size), r, c, pa.array(x, mask=lacks)], ["t", "variable", "r", "c", "value"])


def values(path: str, at: int, n: int, dtype: str) -> np.ndarray:
    with open(path, "rb") as f:
        f.seek(at)
        return np.frombuffer(f.read(n * np.dtype(dtype).itemsize), dtype)


class RecordSeries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_series"

    def schema(self) -> str:
        return "t int, variable string, r int, c int, value double"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader.made(self.options)


def read_records(spark: SparkSession, path: str, year: int | None = None, first: int = 0, flip: bool = False) -> DataFrame:
    """(year, variable, r, c, value) of the two-dimensional record variables of classic series that ``path`` names: a file, folder or pattern. ``first`` is the year of record 0.

    With a ``year`` only its records are read, by their places in the file. ``flip`` turns rows upside down, as in files that begin in the south. The mark of no data and NaN are null.
    """
    reader = reader_of(spark, RecordSeries).option("flip", str(flip).lower())
    if year is not None:
        at = time_index(year, first)
        reader = reader.options(least_t=at, most_t=at)
    return reader.load(path).selectExpr(f"t + {int(first)} AS year", "variable", "r", "c", "value")


class ArrayReader(_Reader):
    columns = ("r",)

    def partitions(self) -> list[InputPartition]:
        parts = []
        for path in paths_of(self.options["path"]):
            with open(path, "rb") as f:
                version = np.lib.format.read_magic(f)
                shape, by_column, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
                begin = f.tell()
            if len(shape) > 2 or kind.hasobject:
                raise ValueError(f"{path} is no array of numbers of one or two dimensions")
            lines, width = (1, *shape)[-2:]  # along which values stand one after the other
            if by_column and len(shape) == 2:
                lines, width = width, lines
            swapped = bool(by_column and len(shape) == 2)
            r0, r1 = (0, lines - 1) if swapped else self.bounds.span("r", lines)
            step = max(1, VALUES // max(1, width))
            parts += [InputPartition((path, begin + k * width * kind.itemsize, k, min(step, r1 + 1 - k), width, kind.str, swapped)) for k in range(r0, r1 + 1, step) if width]
        return parts or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, at, first, lines, width, kind, swapped = partition.value
        x = values(path, at, lines * width, kind).astype(float)
        r, c = np.divmod(np.arange(x.size, dtype=np.int32), np.int32(width))
        r, c = (c, r + np.int32(first)) if swapped else (r + np.int32(first), c)
        yield batch([pa.array([path] * x.size), r, c, pa.array(x, mask=np.isnan(x))], ["path", "r", "c", "value"])


class Arrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saved_arrays"

    def schema(self) -> str:
        return "path string, r int, c int, value double"

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader.made(self.options)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, r, c, value) of saved arrays of numbers of one or two dimensions, by rows or by columns, that ``path`` names: a file, folder or pattern. NaN is null. A task reads some lines of one file."""
    return reader_of(spark, Arrays).load(path)


def time_index(year: int, first: int) -> int:
    """Place of a year in a series that begins at ``first`` (850 in history, 2015 in projections)."""
    if year < first:
        raise ValueError(f"{year} is before {first}")
    return year - first
