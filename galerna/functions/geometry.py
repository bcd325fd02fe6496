"""Great circles, quadrants and radii by quadrant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galerna.constants import EARTH_RADIUS_KM, NAUTICAL_MILE_KM, QUADRANTS
from galerna.functions.basic import lit, non_negative, once

#: Kilometres in a unit, and the spellings of the quadrants.
UNIT_KM = {"km": 1.0, "nm": NAUTICAL_MILE_KM, "nmi": NAUTICAL_MILE_KM, "m": 0.001}
QUADRANT_KEYS = {
    "rne": "rne", "ne": "rne", "rse": "rse", "se": "rse", "rsw": "rsw", "sw": "rsw", "rso": "rsw", "so": "rsw",
    "rnw": "rnw", "nw": "rnw", "rno": "rnw", "no": "rnw",
}


def km_in(unit: str) -> float:
    if unit.lower() not in UNIT_KM:
        raise ValueError(f"unknown unit of length: {unit}")
    return UNIT_KM[unit.lower()]


def quadrant_key(key: str) -> str:
    found = QUADRANT_KEYS.get(key.strip().lower())
    if found is None:
        raise KeyError(f"unknown quadrant: {key}")
    return found


def nautical_miles_to_km(x: Column) -> Column:
    return x * NAUTICAL_MILE_KM


def km_to_nautical_miles(x: Column) -> Column:
    return x / NAUTICAL_MILE_KM


def longitude_difference(x: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def distance_km(lat1, lon1, lat2, lon2, radius_km: float = EARTH_RADIUS_KM, wrap: bool = True) -> Column:
    """Haversine distance."""
    lat1, lon1, lat2, lon2 = map(lit, (lat1, lon1, lat2, lon2))
    dlon = longitude_difference(lon1 - lon2) if wrap else lon1 - lon2
    a = F.pow(F.sin(F.radians(lat1 - lat2) / 2), 2.0) + F.cos(F.radians(lat2)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(dlon) / 2), 2.0)
    return 2 * radius_km * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from point 1 to point 2, 0..360."""
    lat1, lon1, lat2, lon2 = map(lit, (lat1, lon1, lat2, lon2))
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def quadrant(lat, lon, center_lat, center_lon, wrap: bool = True) -> Column:
    """rne, rse, rsw or rnw by the signs of the differences; ties go north and east. Without ``wrap`` longitudes count as they are."""
    lat, lon, center_lat, center_lon = map(lit, (lat, lon, center_lat, center_lon))
    north, east = lat >= center_lat, longitude_difference(lon - center_lon) >= 0 if wrap else lon >= center_lon
    known = (lat + lon + center_lat + center_lon).isNotNull()
    return F.when(known, F.when(north & east, "rne").when(north, "rnw").when(east, "rse").otherwise("rsw"))


def quadrant_of_bearing(bearing: Column) -> Column:
    return F.when(bearing < 90, "rne").when(bearing < 180, "rse").when(bearing < 270, "rsw").when(bearing <= 360, "rnw")


def radii(**columns) -> Column:
    """A struct of the four quadrants; keys in any spelling. A missing quadrant is an error."""
    given = {quadrant_key(k): c for k, c in columns.items()}
    absent = [q for q in QUADRANTS if q not in given]
    if absent:
        raise KeyError(f"radii lack {', '.join(absent)}")
    return F.struct(*(non_negative(lit(given[q]).cast("double")).alias(q) for q in QUADRANTS))


def radii_in_km(r: Column, unit: str) -> Column:
    factor = km_in(unit)
    return F.struct(*(non_negative(r[q] * factor).alias(q) for q in QUADRANTS))


def radius_of(quadrant_name: Column, r: Column) -> Column:
    """The radius of a cell's quadrant."""
    return F.coalesce(*(F.when(quadrant_name == q, r[q]) for q in QUADRANTS))


def mean_of(values: list[Column]) -> Column:
    """Mean of those that are not NULL; NULL if none is."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    return total / F.nullif(n, F.lit(0))


def mean_positive(r: Column) -> Column:
    return mean_of([F.when(r[q] > 0, r[q]) for q in QUADRANTS])


def complete(r: Column) -> Column:
    """All four radii are there (>= 0)."""
    return F.coalesce((r["rne"] >= 0) & (r["rse"] >= 0) & (r["rsw"] >= 0) & (r["rnw"] >= 0), F.lit(False))


def any_valid(r: Column) -> Column:
    out = F.lit(False)
    for q in QUADRANTS:
        out = out | F.coalesce(r[q] >= 0, F.lit(False))
    return out


def filled(r: Column) -> Column:
    """Missing quadrants take the mean of those there (zeros included)."""
    mean = mean_of([r[q] for q in QUADRANTS])
    return F.struct(*(F.coalesce(r[q], mean).alias(q) for q in QUADRANTS))


def filled_quadrants(r: Column) -> Column:
    return F.array_compact(F.array(*(F.when(r[q].isNull(), F.lit(q)) for q in QUADRANTS)))


def uniform(x) -> Column:
    return F.struct(*(lit(x).cast("double").alias(q) for q in QUADRANTS))


def is_null(r: Column) -> Column:
    """No quadrant has a value."""
    return ~any_valid(r)


def grid_key(degrees: Column, per_degree: int = 100) -> Column:
    """Integer key of a coordinate: grids are joined on integers, never on floating point."""
    return F.round(degrees * per_degree).cast("int")


def representative_point(ring: Column) -> Column:
    """A point inside a polygon of one ring (array of (lat, lon)); see ``point_inside``."""
    return point_inside(F.array(ring))


def point_inside(rings: Column) -> Column:
    """A point inside a polygon of any rings, islands and holes alike: the middle of the longest stretch inside at its middle
    latitude."""
    points = F.flatten(rings)
    lats = F.transform(points, lambda p: p["lat"])
    following = lambda ring: F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edge = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    every = F.flatten(F.transform(rings, lambda ring: F.zip_with(ring, following(ring), edge)))

    def of(y: Column) -> Column:
        edges = F.filter(every, lambda e: (e["p"]["lat"] > y) != (e["q"]["lat"] > y))
        at = lambda e: e["p"]["lon"] + (y - e["p"]["lat"]) * (e["q"]["lon"] - e["p"]["lon"]) / (e["q"]["lat"] - e["p"]["lat"])
        crossings = F.array_sort(F.transform(edges, at))

        def longest(x: Column) -> Column:
            stretches = F.transform(
                F.filter(F.sequence(F.lit(0), F.size(x) - 2), lambda k: k % 2 == 0),
                lambda k: F.struct((F.get(x, k + 1) - F.get(x, k)).alias("length"), ((F.get(x, k + 1) + F.get(x, k)) / 2).alias("lon")),
            )
            return F.when(F.size(x) >= 2, F.struct(y.alias("lat"), F.array_max(stretches)["lon"].alias("lon")))

        return once(crossings, longest)

    # a latitude of no vertex, so that an edge is crossed or not
    return once((F.array_min(lats) + F.array_max(lats)) / 2 + 1e-9, of)
