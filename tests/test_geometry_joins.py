"""Polygons of many rings, nearest cells without a cap, grids within a tolerance, places by their words."""

import math
import random

import pytest
from pyspark.sql import functions as F

from galerna.functions import geometry
from galerna.operators import joins
from galerna.sources.staging import finished

RINGS = "place string, place_lat double, place_lon double, rings array<array<struct<lat:double,lon:double>>>"
CELLS = "cell long, cell_lat double, cell_lon double"


def even_odd(rings, lat, lon):
    inside = False
    for ring in rings:
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if (a > lat) != (c > lat) and lon < b + (lat - a) * (d - b) / (c - a):
                inside = not inside
    return inside


def coast(rng, n, lat, lon, size):
    """A wild outline that does not cross itself."""
    return [
        (lat + r * math.sin(t), lon + r * math.cos(t)) for k in range(n) for t, r in [(2 * math.pi * k / n, size * (1 + 0.3 * math.sin(9 * 2 * math.pi * k / n) + 0.05 * rng.random()))]
    ]


def test_islands_holes_and_a_long_coast(spark):
    rng = random.Random(7)
    shapes = {
        "coast": [coast(rng, 30_000, 20.0, -100.0, 3.0), coast(rng, 500, 20.0, -100.0, 1.0), coast(rng, 40, 20.2, -99.8, 0.3), coast(rng, 60, 25.0, -95.0, 0.8)],
        "other": [coast(rng, 300, 21.0, -98.5, 1.5)],
        "square": [[(10.0, 10.0), (10.0, 12.0), (12.0, 12.0), (12.0, 10.0), (10.0, 10.0)]],  # closed, with cells on its edges
        "flat": [[(1.0, 1.0), (1.0, 5.0)], []],
    }
    places = [(p, 20.0, -100.0, [[{"lat": a, "lon": b} for a, b in ring] for ring in rings]) for p, rings in shapes.items()]
    cells = [(40 * i + j, 16 + 0.25 * i, -104 + 0.25 * j) for i in range(44) for j in range(40)] + [(9000 + 10 * i + j, 9.0 + i / 2, 9.0 + j / 2) for i in range(8) for j in range(8)]
    got = {(r.place, r.cell) for r in joins.inside_cells(spark.createDataFrame(places, RINGS), spark.createDataFrame(cells, CELLS)).collect()}
    assert got == {(p, c) for p, rings in shapes.items() for c, lat, lon in cells if even_odd(rings, lat, lon)}
    assert len(got) > 300
    point = spark.createDataFrame(places[:1], RINGS).select(geometry.point_inside(F.col("rings")).alias("p")).head().p
    assert even_odd(shapes["coast"], point.lat, point.lon)


def test_polygons_over_the_date_line(spark):
    ring = [{"lat": a, "lon": b} for a, b in ((0.0, 178.0), (0.0, 183.0), (5.0, 183.0), (5.0, 178.0))]
    places = spark.createDataFrame([("east", 1.0, 179.0, [ring])], RINGS)
    cells = spark.createDataFrame([(k, 2.0, lon) for k, lon in enumerate((177.5, 178.0, 179.5, -179.5, -177.5, -176.5, 0.0))], CELLS)
    assert {r.cell for r in joins.inside_cells(places, cells).collect()} == {1, 2, 3, 4}


def haversine(a, b, c, d):
    x = math.sin(math.radians(a - c) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(b - d) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(x)))


def test_nearest_cells_have_no_cap(spark):
    rng = random.Random(1)
    points = [(f"p{k}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(60)]
    points += [("north", 90.0, 10.0), ("south", -89.9, -170.0), ("line", 0.0, 179.99), ("near", 15.0, -100.1), ("line2", 5.0, -180.0)]
    for cells in ([(1, 15.0, -100.0)], [(k, rng.uniform(-88, 88), rng.uniform(-180, 180)) for k in range(25)], [(3, -20.0, 179.9), (4, -20.0, -179.9), (2, 85.0, 0.0), (99, 85.0, 0.0)]):
        df = spark.createDataFrame(points, "place string, lat double, lon double")
        got = {r.place: r.cell for r in finished(spark, lambda own, c=cells: joins.nearest_cells(df, spark.createDataFrame(c, CELLS), own)).collect()}
        distance = {p: {c: haversine(a, b, x, y) for c, x, y in cells} for p, a, b in points}
        assert got.keys() == distance.keys()
        for p, d in distance.items():
            assert d[got[p]] == pytest.approx(min(d.values()), abs=1e-6)
        assert 99 not in got.values()
    none = finished(spark, lambda own: joins.nearest_cells(df, spark.createDataFrame([], CELLS), own))
    assert none.count() == 0


def test_polygons_without_a_cell_take_the_nearest(spark):
    ring = [{"lat": a, "lon": b} for a, b in ((60.0, 20.0), (60.0, 21.0), (61.0, 20.5))]
    places = spark.createDataFrame([("far", 60.3, 20.5, [ring]), ("none", -60.0, 170.0, [])], RINGS)
    cells = spark.createDataFrame([(1, 15.0, -100.0), (2, 10.0, 90.0)], CELLS)
    got = {(r.place, r.cell, r.n_centres) for r in finished(spark, lambda own: joins.polygon_cells(places, cells, own)).collect()}
    assert got == {("far", 2, 0), ("none", 2, 0)}


def test_grids_within_a_tolerance(spark):
    left = [(1, 10.005, 20.005), (2, 10.0049, 20.0051), (3, -0.0004, 179.9998), (4, 50.0, 50.0), (5, None, 1.0), (1, 10.005, 20.005)]
    right = [(11, 10.0050, 20.0049), (12, 0.0004, -179.9999), (13, 50.0011, 50.0), (14, 10.0058, 20.0051)]
    df, other = spark.createDataFrame(left, "id int, lat double, lon double"), spark.createDataFrame(right, "cell int, lat double, lon double")
    assert sorted((r.id, r.cell) for r in joins.on_grid(df, other).collect()) == sorted([(1, 11), (1, 11), (2, 11), (3, 12), (4, None), (5, None)], key=str)
    with pytest.raises(ValueError, match="both grids have id"):
        joins.near_grid(df, other.withColumnRenamed("cell", "id"))


def test_places_by_words_or_an_error(spark):
    places = [
        ("01", "San José de los Cabos", "B"), ("02", "San José del Progreso", "B"), ("03", "La Paz y Puerto", "B"), ("04", "La Paz", "C"), ("05", "La Paz", "C"), ("06", "Cabos", "B"), ("07", "El", "D"),
    ]
    asked = [
        (1, "los cabos", "B", None), (2, "san jose", "B", "06"), (3, "PUERTO la paz", "B", None), (4, "La Paz", "C", "01"), (5, "Nowhere San", "B", "04"), (6, "san xyz", "B", "99"), (7, "paz y", "B", None),
        (8, "cabos jose", "B", None), (9, "de la", "D", None), (9, "de la", "B", None), (10, "los cabos", "B", None),
    ]
    found = joins.find_place(spark.createDataFrame(places, "code string, name string, state string"), spark.createDataFrame(asked, "wanted_id int, wanted string, state string, back string"), "back")
    got = {(r.wanted_id, r.state): (r.code, r.how, r.hits) for r in found.collect()}
    assert got == {
        (1, "B"): (None, "several", 2), (2, "B"): (None, "several", 2), (3, "B"): ("03", "words", 1), (4, "C"): (None, "several", 2), (5, "B"): ("04", "code", 0), (6, "B"): (None, "none", 0),
        (7, "B"): ("03", "words", 1), (8, "B"): ("01", "words", 1), (9, "D"): ("07", "words", 1), (9, "B"): (None, "several", 4), (10, "B"): (None, "several", 2),
    }
    assert {r.wanted_id: r.similar for r in found.filter("wanted_id in (2, 6)").collect()} == {k: ["San José de los Cabos", "San José del Progreso"] for k in (2, 6)}
    assert joins.require_places(found.filter("wanted_id = 3")).count() == 1
    with pytest.raises(ValueError, match="los cabos"):
        joins.require_places(found)
