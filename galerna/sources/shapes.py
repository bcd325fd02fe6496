"""Polygon files (.shp with .shx, .dbf and .prj) as a Spark data source: ``spark.read.format("polygons")``.

The index file gives the place of each record, so that a file is cut into partitions of about ``partition_bytes`` which tasks
read on their own; the driver reads index and headers alone. Records outside the option ``box`` (lat_min, lat_max, lon_min, lon_max) are
passed over by the bounds in their first bytes. Coordinates of a conformal conic projection become degrees.

Rows hold the attributes and ``rings``, arrays of (lat, lon): outer rings, islands and holes alike. A record without a shape has no
rings; a deleted attribute row keeps its shape.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from galerna.functions.text import code5, column_name

RING = T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
#: Kinds of records that hold polygons, with heights or measures or without.
POLYGONS = (5, 15, 25)


@dataclass(frozen=True)
class Conic:
    """A conformal conic projection with two standard parallels, on an ellipsoid."""

    lat0: float
    lon0: float
    lat1: float
    lat2: float
    east: float
    north: float
    axis: float
    flattening: float

    def _terms(self) -> tuple[float, float, float, float]:
        e = math.sqrt(2 * self.flattening - self.flattening**2)
        m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
        t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
        p1, p2, p0 = (math.radians(x) for x in (self.lat1, self.lat2, self.lat0))
        n = math.sin(p1) if abs(p1 - p2) < 1e-12 else (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
        scale = self.axis * m(p1) / (n * t(p1) ** n)
        return e, n, scale, scale * t(p0) ** n

    def forward(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e, n, scale, rho0 = self._terms()
        p = np.radians(lat)
        t = np.tan(np.pi / 4 - p / 2) / ((1 - e * np.sin(p)) / (1 + e * np.sin(p))) ** (e / 2)
        rho, angle = scale * t**n, n * np.radians(lon - self.lon0)
        return self.east + rho * np.sin(angle), self.north + rho0 - rho * np.cos(angle)

    def inverse(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e, n, scale, rho0 = self._terms()
        dx, dy = x - self.east, rho0 - (y - self.north)
        sign = math.copysign(1.0, n)
        t = (sign * np.hypot(dx, dy) / scale) ** (1 / n)
        p = np.pi / 2 - 2 * np.arctan(t)
        for _ in range(8):  # each step gains more than two digits
            p = np.pi / 2 - 2 * np.arctan(t * ((1 - e * np.sin(p)) / (1 + e * np.sin(p))) ** (e / 2))
        return np.degrees(p), self.lon0 + np.degrees(np.arctan2(sign * dx, sign * dy)) / n


def projection_of(text: str) -> Conic | None:
    """From the text of a .prj file; None for plain degrees. Another projection is an error."""
    if not re.search(r"PROJ(?:CS|CRS)", text):
        return None
    if not re.search("Lambert_Conformal_Conic", text, re.IGNORECASE):
        raise ValueError("only conformal conic projections and degrees can be read")
    number = r"\s*([-+0-9.eE]+)"
    values = {k.lower(): float(v) for k, v in re.findall(rf'PARAMETER\["([^"]+)",{number}', text, re.IGNORECASE)}
    axis, inverse = map(float, re.search(rf'SPHEROID\["[^"]*",{number},{number}', text, re.IGNORECASE).groups())
    first = values.get("standard_parallel_1", values.get("latitude_of_origin", 0.0))
    return Conic(
        values.get("latitude_of_origin", 0.0), values.get("central_meridian", 0.0), first, values.get("standard_parallel_2", first),
        values.get("false_easting", 0.0), values.get("false_northing", 0.0), axis, 1 / inverse if inverse else 0.0,
    )


def _bytes(path: str) -> bytes | None:
    where, own = fs.FileSystem.from_uri(path)
    if where.get_file_info(own).type == fs.FileType.NotFound:
        return None
    with where.open_input_file(own) as f:
        return f.read()


@dataclass(frozen=True)
class Attributes:
    """Layout of a .dbf file."""

    start: int
    size: int
    rows: int
    fields: tuple[tuple[str, str, int, int, int], ...]  # name, kind, place, length, decimals
    encoding: str

    @staticmethod
    def of(path: str, encoding: str | None) -> "Attributes":
        where, own = fs.FileSystem.from_uri(path + ".dbf")
        with where.open_input_file(own) as f:
            rows, start, size = struct.unpack("<IHH", f.read(12)[4:])
            f.seek(32)
            head = f.read(start - 32)
        fields, at = [], 1
        for k in range(0, len(head) - 31, 32):
            if head[k] == 0x0D:
                break
            name, kind, length, decimals = head[k : k + 11].split(b"\0")[0].decode("ascii"), chr(head[k + 11]), head[k + 16], head[k + 17]
            fields.append((column_name(name), kind, at, length, decimals))
            at += length
        page = (_bytes(path + ".cpg") or b"").decode("ascii", "ignore").strip()
        return Attributes(start, size, rows, tuple(fields), encoding or page or "utf-8")

    def type_of(self, kind: str, decimals: int) -> T.DataType:
        if kind in "NF":
            return T.DoubleType() if decimals or kind == "F" else T.LongType()
        return T.StringType()

    def values(self, row: bytes) -> list:
        out = []
        for _, kind, at, length, decimals in self.fields:
            text = row[at : at + length].decode(self.encoding, "replace").strip(" \0")
            number = float if decimals or kind == "F" else int
            out.append((number(text) if text and "*" not in text else None) if kind in "NF" else text or None)
        return out


class Part(InputPartition):
    """Consecutive records: number of the first one, and the places of all in the file."""

    def __init__(self, first: int, offsets: list[int], lengths: list[int]):
        super().__init__(None)
        self.first, self.offsets, self.lengths = first, offsets, lengths


class PolygonReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = re.sub(r"(?i)\.shp$", "", options["path"])
        if "://" not in self.path and not self.path.startswith(("/", "file:")):
            raise ValueError("give an absolute path")
        self.path = re.sub("^file:/*", "/", self.path)
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.box = tuple(map(float, options["box"].split(","))) if options.get("box") else None
        self.attributes = Attributes.of(self.path, options.get("encoding"))
        text = _bytes(self.path + ".prj")
        self.conic = projection_of(text.decode("utf-8", "replace")) if text else None

    def partitions(self) -> list[Part]:
        index = np.frombuffer(_bytes(self.path + ".shx"), ">i4", offset=100).reshape(-1, 2).astype(np.int64) * 2
        if not len(index):
            return [Part(0, [], [])]
        part = np.cumsum(index[:, 1]) // self.partition_bytes
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(index)]
        return [Part(a, index[a:b, 0].tolist(), index[a:b, 1].tolist()) for a, b in zip(cuts, cuts[1:])]

    def _bounds(self) -> tuple[float, float, float, float] | None:
        """The box in the file's coordinates, a little wider: a box's outline bounds what lies inside."""
        if not self.box:
            return None
        a, b, c, d = self.box
        if not self.conic:
            return c, a, d, b
        side = np.linspace(0, 1, 65)
        lat = np.concatenate([a + (b - a) * side, a + (b - a) * side, np.full(65, a), np.full(65, b)])
        lon = np.concatenate([np.full(65, c), np.full(65, d), c + (d - c) * side, c + (d - c) * side])
        x, y = self.conic.forward(lat, lon)
        room = 0.01 * max(np.ptp(x), np.ptp(y))
        return x.min() - room, y.min() - room, x.max() + room, y.max() + room

    def read(self, partition: Part) -> Iterator[tuple]:
        bounds, a = self._bounds(), self.attributes
        (shapes, own), (table, rows) = (fs.FileSystem.from_uri(self.path + end) for end in (".shp", ".dbf"))
        with shapes.open_input_file(own) as f, table.open_input_file(rows) as g:
            for k, (offset, length) in enumerate(zip(partition.offsets, partition.lengths)):
                f.seek(offset + 8)
                head = f.read(min(length, 44))
                kind = struct.unpack_from("<i", head)[0]
                rings: list = []
                if kind in POLYGONS:
                    west, south, east, north, n_parts, n_points = struct.unpack_from("<4d2i", head, 4)
                    if bounds and (east < bounds[0] or north < bounds[1] or west > bounds[2] or south > bounds[3]):
                        continue
                    data = f.read(4 * n_parts + 16 * n_points)
                    starts = np.frombuffer(data, "<i4", n_parts).tolist()
                    points = np.frombuffer(data, "<f8", 2 * n_points, 4 * n_parts).reshape(-1, 2)
                    lat, lon = self.conic.inverse(points[:, 0], points[:, 1]) if self.conic else (points[:, 1], points[:, 0])
                    if self.box and not (lat.max() >= self.box[0] and lat.min() <= self.box[1] and lon.max() >= self.box[2] and lon.min() <= self.box[3]):
                        continue
                    places = list(zip(lat.tolist(), lon.tolist()))
                    rings = [places[s:e] for s, e in zip(starts, [*starts[1:], n_points])]
                elif kind != 0:
                    raise ValueError(f"record {partition.first + k} holds no polygon but kind {kind}")
                elif bounds:
                    continue
                g.seek(a.start + (partition.first + k) * a.size)
                yield (*a.values(g.read(a.size)), rings)


class PolygonSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polygons"

    def schema(self) -> T.StructType:
        a = PolygonReader(self.options).attributes
        return T.StructType([*(T.StructField(n, a.type_of(kind, decimals)) for n, kind, _, _, decimals in a.fields), T.StructField("rings", T.ArrayType(RING))])

    def reader(self, schema: T.StructType) -> PolygonReader:
        return PolygonReader(self.options)


def polygons(spark: SparkSession, path: str, code: str, name: str | None = None, **options) -> DataFrame:
    """(place, name, place_lat, place_lon, rings) of a polygon file: the code padded to five digits, and a point inside."""
    from galerna.functions.geometry import point_inside

    spark.dataSource.register(PolygonSource)
    df = spark.read.format("polygons").options(**options).load(path).withColumn("__p", point_inside(F.col("rings")))
    label = F.col(name) if name else F.lit(None).cast("string")
    return df.select(code5(F.col(code)).alias("place"), label.alias("name"), F.col("__p.lat").alias("place_lat"), F.col("__p.lon").alias("place_lon"), "rings")
