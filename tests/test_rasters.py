"""Chunked rasters: a grid of events written, boxes and times read back, only their chunks opened."""

import json
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from galerna.plans import standins as P
from galerna.sources import rasters, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("r") / "rain.zarr")
    s = P.series(spark, SF).join(P.grid(spark, SF), "cell")
    df = s.select("time", F.col("cell_lat").alias("lat"), F.col("cell_lon").cast("double").alias("lon"), F.col("p6").alias("precipitation")).cache()
    rasters.write_raster(df, path, "precipitation", (16, 2, 1), {"units": "mm"})
    spark.dataSource.register(rasters.RasterSource)
    return path, df


def test_a_grid_reads_back(spark, store):
    path, df = store
    back = spark.read.format("raster").load(path)
    assert back.columns == ["time", "lat", "lon", "precipitation"]
    sides = [df.select(c).distinct().count() for c in ("time", "lat", "lon")]
    assert back.count() == int(np.prod(sides)) and back.rdd.getNumPartitions() == -(-sides[0] // 16) * -(-sides[1] // 2) * sides[2]
    got = {(r.time, r.lat, r.lon): r.precipitation for r in back.filter("precipitation is not null").collect()}
    want = {(r.time, r.lat, r.lon): r.precipitation for r in df.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    assert tables.rain(back, synoptic_only=False).columns == ["valid_time", "lat", "lon", "precipitation"]
    with pytest.raises(ValueError, match="already"):
        rasters.write_raster(df, path, "precipitation")
    assert len(os.listdir(os.path.dirname(path))) == 1  # nothing is left beside it


def test_only_the_chunks_of_a_box_are_opened(spark, store, tmp_path):
    path, df = store
    first, last = "2024-01-05T00:00:00", "2024-01-06T18:00:00"
    box = (13.5, 16.5, -118.5, -114.5)
    chosen = spark.read.format("raster").options(box=",".join(map(str, box)), times=f"{first},{last}").load(path)
    own = df.filter(F.col("time").between(first, last) & F.col("lat").between(*box[:2]) & F.col("lon").between(*box[2:]))
    assert chosen.filter("precipitation is not null").count() == own.count() > 0
    # all other chunks are spoilt: reading any of them would fail
    reader = rasters.RasterReader({"path": path, "box": ",".join(map(str, box)), "times": f"{first},{last}"})
    wanted = {".".join(map(str, c.place)) for c in reader.partitions()}
    copy = str(tmp_path / "c.zarr")
    for folder, _, names in os.walk(path):
        for n in names:
            to = f"{copy}{folder[len(path):]}/{n}"
            os.makedirs(os.path.dirname(to), exist_ok=True)
            spoilt = "/precipitation" in folder and n[0].isdigit() and n not in wanted
            open(to, "wb").write(b"no zlib" if spoilt else open(f"{folder}/{n}", "rb").read())
    again = spark.read.format("raster").options(box=",".join(map(str, box)), times=f"{first},{last}").load(copy)
    assert sorted(again.collect(), key=str) == sorted(chosen.collect(), key=str)
    with pytest.raises(Exception, match="zlib|header|incorrect"):
        spark.read.format("raster").load(copy).collect()
    assert spark.read.format("raster").option("box", "80,81,0,1").load(path).count() == 0


def test_stores_of_others(spark, tmp_path):
    """Whole numbers with scale, big endian, no compression, absent chunks, hours since a date, longitudes to 360."""
    root = tmp_path / "o.zarr"

    def put(name, values, chunks, attributes, **layout):
        (root / name).mkdir(parents=True)
        z = {"zarr_format": 2, "shape": list(values.shape), "chunks": list(chunks), "dtype": values.dtype.str, "fill_value": None, "order": "C", "filters": None, "compressor": None} | layout
        (root / name / ".zarray").write_text(json.dumps(z))
        (root / name / ".zattrs").write_text(json.dumps(attributes))
        return lambda place, block: (root / name / place).write_bytes(block)

    put("time", np.array([6, 12, 18], ">i4"), (3,), {"units": "hours since 2024-05-01 00:00:00"})("0", np.array([6, 12, 18], ">i4").tobytes())
    put("latitude", np.array([20.0, 19.9], "<f4"), (2,), {}, compressor={"id": "gzip", "level": 1})("0", zlib.compress(np.array([20.0, 19.9], "<f4").tobytes(), wbits=31))
    put("longitude", np.array([259.0, 260.0, 261.0], "<f8"), (3,), {})("0", np.array([259.0, 260.0, 261.0], "<f8").tobytes())
    value = np.arange(18, dtype=">i2").reshape(3, 2, 3)
    value[0, 0, 1] = -999
    save = put("tp", value, (2, 2, 2), {"scale_factor": 0.5, "add_offset": 1.0, "_FillValue": -999, "_ARRAY_DIMENSIONS": ["time", "latitude", "longitude"]}, dimension_separator="/")
    for t in range(2):
        for x in range(2):
            if (t, x) != (1, 1):
                block = np.full((2, 2, 2), -999, ">i2")
                part = value[2 * t : 2 * t + 2, :, 2 * x : 2 * x + 2]
                block[: part.shape[0], :, : part.shape[2]] = part
                (root / "tp" / str(t) / "0").mkdir(parents=True, exist_ok=True)
                save(f"{t}/0/{x}", block.tobytes())
    spark.dataSource.register(rasters.RasterSource)
    rows = tables.rain(spark.read.format("raster").load(str(root))).collect()
    got = {(r.valid_time.hour, round(r.lat, 1), r.lon): r.precipitation for r in rows}
    assert len(got) == 18
    for t, y, x in np.ndindex(3, 2, 3):
        missing = (t, y, x) == (0, 0, 1) or (t, x) == (2, 2)
        assert got[6 * (t + 1), (20.0, 19.9)[y], -101.0 + x] == (None if missing else 0.5 * int(value[t, y, x]) + 1.0)
    with pytest.raises(Exception, match="no variable"):
        spark.read.format("raster").option("variable", "snow").load(str(root)).collect()
