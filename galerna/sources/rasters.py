"""Chunked rasters (Zarr, version 2) as a Spark data source: ``spark.read.format("raster")``, and a writer that commits whole.

A store is a folder of arrays; time, latitude and longitude are arrays of one dimension, the variable has all three. Each chunk of
the variable is a partition of its own, and only chunks that meet the options ``box`` (lat_min, lat_max, lon_min, lon_max) and ``times``
(first, last) are opened; the driver reads the axes alone. Chunks are plain or zlib-compressed, little or big endian, of
real or whole numbers, with scale and offset; absent chunks, fill values and NaN are missing and give NULL.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from galerna.sources.tables import LAT_NAMES, LON_NAMES, RAIN_NAMES, TIME_NAMES

#: Microseconds in the units of time axes.
UNITS = {"microseconds": 1, "milliseconds": 1000, "seconds": 10**6, "minutes": 60 * 10**6, "hours": 3600 * 10**6, "days": 86400 * 10**6}
#: Steps, rows and columns of a chunk that is written.
CHUNKS = (64, 128, 128)


class Store:
    """A folder of arrays, wherever pyarrow reads."""

    def __init__(self, path: str):
        self.fs, self.root = fs.FileSystem.from_uri(re.sub("^file:/*", "/", path.rstrip("/")))

    def read(self, name: str) -> bytes | None:
        at = f"{self.root}/{name}"
        if self.fs.get_file_info(at).type == fs.FileType.NotFound:
            return None
        with self.fs.open_input_file(at) as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        """Whole or not at all: a task that runs again replaces what it has written."""
        at = f"{self.root}/{name}"
        self.fs.create_dir(at.rsplit("/", 1)[0])
        part = f"{at}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(data)
        self.fs.move(part, at)

    def arrays(self) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(self.root, recursive=False))
        return sorted(x.base_name for x in found if x.type == fs.FileType.Directory and self.read(f"{x.base_name}/.zarray"))


class Array:
    """An array of a store: its layout and its attributes."""

    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name
        data = store.read(f"{name}/.zarray")
        if data is None:
            raise ValueError(f"no array {name}")
        z = json.loads(data)
        if z["zarr_format"] != 2 or z.get("filters") or z.get("order", "C") != "C" or (z["compressor"] or {"id": "zlib"})["id"] not in ("zlib", "gzip"):
            raise ValueError(f"{name}: only plain or zlib-compressed arrays of format 2 in rows can be read")
        self.shape, self.chunks, self.dtype = tuple(z["shape"]), tuple(z["chunks"]), np.dtype(z["dtype"])
        self.fill, self.packed, self.joint = z.get("fill_value"), (z["compressor"] or {}).get("id"), z.get("dimension_separator", ".")
        self.attributes = json.loads(store.read(f"{name}/.zattrs") or b"{}")

    def chunk(self, place: tuple[int, ...]) -> np.ndarray | None:
        """Values of a chunk as floating point, NaN where missing; None for an absent chunk."""
        data = self.store.read(f"{self.name}/{self.joint.join(map(str, place))}")
        if data is None:
            return None
        if self.packed:
            data = zlib.decompress(data, 47)  # either header
        raw = np.frombuffer(data, self.dtype).reshape(self.chunks)
        raw = raw[tuple(slice(0, max(0, n - p * c)) for n, p, c in zip(self.shape, place, self.chunks))]
        out = raw.astype(float)
        for missing in (self.fill, self.attributes.get("_FillValue"), self.attributes.get("missing_value")):
            if missing is not None and missing != "NaN":
                out[raw == np.array(missing).astype(self.dtype)] = np.nan
        return out * self.attributes.get("scale_factor", 1.0) + self.attributes.get("add_offset", 0.0)

    def axis(self) -> np.ndarray:
        parts = [self.chunk((k,)) for k in range(-(-self.shape[0] // self.chunks[0]))]
        return np.concatenate(parts) if parts else np.zeros(0)

    def times(self) -> np.ndarray:
        """Microseconds since 1970 of a time axis."""
        found = re.match(r"(\w+) since (\d{4}-\d{1,2}-\d{1,2})(?:[ T](\d{1,2}:\d{2}(?::\d{2})?))?", self.attributes.get("units", ""))
        if not found or found[1] not in UNITS:
            raise ValueError(f"{self.name}: unknown unit of time {self.attributes.get('units')!r}")
        y, m, d = map(int, found[2].split("-"))
        clock = [int(x) for x in (found[3] or "0:0").split(":")]
        start = dt.datetime(y, m, d, *clock, tzinfo=dt.UTC)
        base = (start - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
        return base + np.round(self.axis() * UNITS[found[1]]).astype(np.int64)


class Chunk(InputPartition):
    def __init__(self, place: tuple[int, ...], inside: list[list[int]]):
        super().__init__(None)
        self.place, self.inside = place, inside


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.options = options["path"], dict(options)
        store = Store(self.path)
        names = store.arrays()

        def one(kind: str, candidates: tuple[str, ...]) -> str:
            given = options.get(kind)
            found = [n for n in ((given,) if given else candidates) if n in names]
            if not found:
                raise ValueError(f"no {kind} among {names}")
            return found[0]

        self.variable, self.axes = one("variable", RAIN_NAMES), (one("time", TIME_NAMES), one("lat", LAT_NAMES), one("lon", LON_NAMES))

    def _axes(self, store: Store) -> list[np.ndarray]:
        return [Array(store, self.axes[0]).times(), *(Array(store, a).axis() for a in self.axes[1:])]

    def partitions(self) -> list[Chunk]:
        store = Store(self.path)
        array = Array(store, self.variable)
        named = array.attributes.get("_ARRAY_DIMENSIONS", list(self.axes))
        if list(named) != list(self.axes):
            raise ValueError(f"{self.variable} has dimensions {named}, not {self.axes}")
        times, lat, lon = self._axes(store)
        inside = [np.ones(len(x), bool) for x in (times, lat, lon)]
        if self.options.get("times"):
            first, last = ((dt.datetime.fromisoformat(x).replace(tzinfo=dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1) for x in self.options["times"].split(","))
            inside[0] = (times >= first) & (times <= last)
        if self.options.get("box"):
            a, b, c, d = map(float, self.options["box"].split(","))
            inside[1], inside[2] = (lat >= a) & (lat <= b), (lon >= c) & (lon <= d)
        some = [[(k, own) for k in range(-(-n // c)) if (own := (np.flatnonzero(m[k * c : (k + 1) * c])).tolist())] for m, n, c in zip(inside, array.shape, array.chunks)]
        return [Chunk(tuple(k for k, _ in each), [own for _, own in each]) for each in product(*some)] or [Chunk((), [])]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        if not partition.place:
            return
        store = Store(self.path)
        array, axes = Array(store, self.variable), self._axes(store)
        block = array.chunk(partition.place)
        t, y, x = (a[np.array(own) + p * c] for a, own, p, c in zip(axes, partition.inside, partition.place, array.chunks))
        step = max(1, (1 << 18) // max(1, len(y) * len(x)))
        for at in range(0, len(t), step):
            own = partition.inside[0][at : at + step]
            values = np.full(len(own) * len(y) * len(x), np.nan) if block is None else block[np.ix_(own, *partition.inside[1:])].reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(t[at : at + step], len(y) * len(x)), pa.timestamp("us", "UTC")), pa.array(np.tile(np.repeat(y, len(x)), len(own))),
                 pa.array(np.tile(x, len(own) * len(y))), pa.array(values, mask=np.isnan(values))],
                ["time", "lat", "lon", self.variable],
            )


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> T.StructType:
        name = RasterReader(self.options).variable
        return T.StructType([T.StructField("time", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in ("lat", "lon", name))])

    def reader(self, schema: T.StructType) -> RasterReader:
        return RasterReader(self.options)


def _described(shape: tuple[int, ...], chunks: tuple[int, ...], dtype: str, fill) -> bytes:
    return json.dumps({
        "zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype, "fill_value": fill, "order": "C", "filters": None, "compressor": {"id": "zlib", "level": 5},
    }).encode()


def write_raster(df: DataFrame, path: str, variable: str, chunks: tuple[int, int, int] = CHUNKS, attributes: dict | None = None) -> None:
    """``df`` (time, lat, lon and ``variable``) as a store of one variable at ``path``, which must not exist.

    The axes are the distinct coordinates, which the driver holds (a raster's sides, not its points); each chunk is put together by the
    task that has its points, of repeated points the largest. All is written beside the path and takes its name at the end, so
    that a store is there whole or not at all.
    """
    target, temporary = Store(path), Store(f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    if target.fs.get_file_info(target.root).type != fs.FileType.NotFound:
        raise ValueError(f"{path} is there already")
    sides = [[r[0] for r in df.select(c).distinct().orderBy(c).collect()] for c in (F.unix_micros(F.col("time").cast("timestamp")).alias("t"), F.col("lat").cast("double"), F.col("lon").cast("double"))]
    shape, names = tuple(map(len, sides)), ("time", "lat", "lon")
    chunks = tuple(max(1, min(c, n)) for c, n in zip(chunks, shape))
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast([np.array(s, np.int64 if k == 0 else float) for k, s in enumerate(sides)])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Points by their chunk and their place in it."""
        for batch in batches:
            at = [np.searchsorted(s, batch.column(k).to_numpy()) for k, s in enumerate(sent.value)]
            number = lambda parts, sizes: (parts[0] * sizes[1] + parts[1]) * sizes[2] + parts[2]
            counts = [-(-n // c) for n, c in zip(shape, chunks)]
            chunk = number([a // c for a, c in zip(at, chunks)], counts)
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(number([a % c for a, c in zip(at, chunks)], chunks)), batch.column(3)], ["chunk", "at", "value"])

    def save(points: pa.Table) -> pa.Table:
        counts = [-(-n // c) for n, c in zip(shape, chunks)]
        k = points.column("chunk")[0].as_py()
        block = np.full(int(np.prod(chunks)), np.nan, "<f4")
        block[points.column("at").to_numpy()] = points.column("value").to_numpy()
        place = (k // (counts[1] * counts[2]), k // counts[2] % counts[1], k % counts[2])
        Store(temporary_path).write(f"{variable}/{'.'.join(map(str, place))}", zlib.compress(block.tobytes(), 5))
        return pa.table({"chunk": [k]})

    temporary_path = f"{path.rstrip('/')}.{temporary.root.rsplit('.', 1)[-1]}"
    numbers = df.select(F.unix_micros(F.col("time").cast("timestamp")).alias("t"), F.col("lat").cast("double"), F.col("lon").cast("double"), F.col(variable).cast("double").alias("v"))
    points = numbers.filter(F.col("v").isNotNull() & F.col("t").isNotNull()).mapInArrow(placed, "chunk long, at long, value double").groupBy("chunk", "at").agg(F.max("value").alias("value"))
    points.groupBy("chunk").applyInArrow(save, "chunk long").count()
    for k, (name, side) in enumerate(zip(names, sides)):
        values = np.array(side, "<i8" if k == 0 else "<f8")
        temporary.write(f"{name}/.zarray", _described((len(side),), (max(1, len(side)),), values.dtype.str, None))
        temporary.write(f"{name}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": [name]} | ({"units": "microseconds since 1970-01-01"} if k == 0 else {})).encode())
        if len(side):
            temporary.write(f"{name}/0", zlib.compress(values.tobytes(), 5))
    temporary.write(f"{variable}/.zarray", _described(shape, chunks, "<f4", "NaN"))
    temporary.write(f"{variable}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": list(names)} | (attributes or {})).encode())
    temporary.write(".zgroup", b'{"zarr_format": 2}')
    target.fs.move(temporary.root, target.root)
