"""Polygon files: written from a given table, read back by partitions and boxes, in degrees and projected."""

import math
import struct

import numpy as np
import pytest

from galerna.operators import joins
from galerna.sources import shapes

CONIC = shapes.Conic(12.0, -102.0, 17.5, 29.5, 2_500_000.0, 0.0, 6378137.0, 1 / 298.257222101)
PRJ = (
    'PROJCS["x",GEOGCS["y",DATUM["z",SPHEROID["GRS 1980",6378137.0,298.257222101]]],PROJECTION["Lambert_Conformal_Conic"],PARAMETER["False_Easting",2500000.0],'
    'PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-102.0],PARAMETER["Standard_Parallel_1",17.5],PARAMETER["Standard_Parallel_2",29.5],PARAMETER["Latitude_Of_Origin",12.0]]'
)


def write(path, records, conic=None, prj=""):
    """``records``: (code, name, area, rings of (lat, lon))."""
    body, index = b"", b""
    for k, (*_, rings) in enumerate(records, 1):
        if rings:
            lat, lon = np.array([p for r in rings for p in r]).T
            x, y = conic.forward(lat, lon) if conic else (lon, lat)
            starts = np.cumsum([0, *map(len, rings)])[:-1]
            content = struct.pack("<i4d2i", 5, x.min(), y.min(), x.max(), y.max(), len(rings), len(x)) + starts.astype("<i4").tobytes() + np.column_stack([x, y]).astype("<f8").tobytes()
        else:
            content = struct.pack("<i", 0)
        index += struct.pack(">2i", (100 + len(body)) // 2, len(content) // 2)
        body += struct.pack(">2i", k, len(content) // 2) + content
    for end, data in (("shp", body), ("shx", index)):
        (path.parent / f"{path.name}.{end}").write_bytes(struct.pack(">i20xi", 9994, (100 + len(data)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + data)
    fields = [("CVE GEO", "N", 5, 0), ("NOMGEO", "C", 20, 0), ("AREA", "N", 12, 3)]
    head = b"".join(struct.pack("<11sc4xBB14x", n.encode(), t.encode(), size, d) for n, t, size, d in fields) + b"\r"
    rows = b"".join(b" " + str(c).rjust(5).encode() + n.encode("latin-1").ljust(20) + (b"" if a is None else f"{a:.3f}".encode()).rjust(12) for c, n, a, _ in records)
    (path.parent / f"{path.name}.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 124, 1, 1, len(records), 32 + len(head), 38) + head + rows + b"\x1a")
    (path.parent / f"{path.name}.cpg").write_text("latin-1")
    if prj:
        (path.parent / f"{path.name}.prj").write_text(prj)


@pytest.fixture(scope="module")
def records(spark):
    nations = spark.read.parquet("/root/testdata/sf0.001/nation.parquet").orderBy("n_nationkey").collect()
    out = []
    for r in nations:
        lat, lon = 15.0 + r.n_nationkey % 5 * 3, -115.0 + r.n_nationkey // 5 * 4
        ring = [(lat + (1 + 0.3 * math.sin(7 * t)) * math.sin(t), lon + (1 + 0.3 * math.sin(7 * t)) * math.cos(t)) for t in np.linspace(0, 2 * math.pi, 200)]
        hole = [(lat + 0.2, lon - 0.2), (lat + 0.2, lon + 0.2), (lat - 0.2, lon + 0.2)]
        out.append((r.n_nationkey + 1, r.n_name.title().replace("A", "Á"), None if r.n_nationkey == 3 else r.n_nationkey / 8, [] if r.n_nationkey == 4 else [ring, hole][: 1 + r.n_nationkey % 2]))
    return out


@pytest.mark.parametrize("projected", [False, True])
def test_files_read_back(spark, tmp_path, records, projected):
    write(tmp_path / "p", records, CONIC if projected else None, PRJ if projected else "")
    spark.dataSource.register(shapes.PolygonSource)
    df = spark.read.format("polygons").option("partition_bytes", 8000).load(f"{tmp_path}/p.shp")
    assert df.columns == ["cve_geo", "nomgeo", "area", "rings"] and df.rdd.getNumPartitions() > 5
    rows = sorted(df.collect())
    assert [(r.cve_geo, r.nomgeo, r.area) for r in rows] == [(c, n, a) for c, n, a, _ in records]
    for r, (*_, rings) in zip(rows, records):
        assert [len(x) for x in r.rings] == [len(x) for x in rings]
        assert np.allclose([p for x in r.rings for p in x] or [[0, 0]], [p for x in rings for p in x] or [[0, 0]], atol=1e-9)
    box = (17.0, 22.0, -112.0, -106.0)
    some = spark.read.format("polygons").option("box", ",".join(map(str, box))).load(f"{tmp_path}/p.shp").collect()
    meets = lambda rings: rings and max(p[0] for p in rings[0]) >= box[0] and min(p[0] for p in rings[0]) <= box[1] and max(p[1] for p in rings[0]) >= box[2] and min(p[1] for p in rings[0]) <= box[3]
    assert sorted(r.cve_geo for r in some) == [c for c, *_, rings in records if meets(rings)] and 0 < len(some) < len(records)


def test_places_of_a_file_take_their_cells(spark, tmp_path, records):
    write(tmp_path / "p", records, CONIC, PRJ)
    places = shapes.polygons(spark, f"{tmp_path}/p.shp", "cve_geo", "nomgeo")
    assert {r.place for r in places.collect()} == {f"{c:05d}" for c, *_ in records}
    cells = spark.createDataFrame([(f"{c:05d}", 15.0 + (c - 1) % 5 * 3, -115.7 + (c - 1) // 5 * 4) for c, *_ in records], "cell string, cell_lat double, cell_lon double")
    assert {(r.place, r.cell) for r in joins.inside_cells(places, cells).collect()} == {(f"{c:05d}",) * 2 for c, *_, rings in records if rings}
    inside = {r.place: r for r in places.collect()}
    assert inside["00005"].place_lat is None and inside["00001"].place_lat == pytest.approx(15.0, abs=0.2)


def test_projections(spark):
    rng = np.random.default_rng(2)
    lat, lon = rng.uniform(-60, 75, 500), rng.uniform(-180, -20, 500)
    for conic in (CONIC, shapes.Conic(0.0, -96.0, -20.0, -60.0, 0.0, 0.0, 6378388.0, 1 / 297.0), shapes.Conic(30.0, -90.0, 33.0, 33.0, 1.0, 2.0, 6371000.0, 0.0)):
        assert np.allclose(conic.inverse(*conic.forward(lat, lon)), (lat, lon), atol=1e-8)
    assert shapes.projection_of(PRJ) == CONIC and shapes.projection_of('GEOGCS["WGS84"]') is None
    with pytest.raises(ValueError, match="conic"):
        shapes.projection_of('PROJCS["x",PROJECTION["Transverse_Mercator"]]')
