"""Joins of tracks, rain, cells and places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galerna.constants import EARTH_RADIUS_CASES_KM
from galerna.functions.geometry import bearing_deg, distance_km, longitude_difference, quadrant_of_bearing, radius_of
from galerna.functions.time import MICROS, bucket, is_synoptic, micros
from galerna.sources.staging import Staging

KM_A_DEGREE = 111.19


def bin_of(degrees: Column, size: float) -> Column:
    return F.floor(degrees / size).cast("int")


def storm_cells(tracks: DataFrame, cells: DataFrame, reach_km: Column | float, bin_degrees: float = 5.0, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of storm positions and cells within ``reach_km``, with ``dist_km``.

    ``tracks`` has lat and lon, ``cells`` cell, cell_lat and cell_lon, both the columns ``on`` to agree in (as the
    time). Positions go to the bins of latitude and longitude that their reach meets, cells to their own bin, and an
    equi-join of bins replaces the join of all with all. Bins wrap at the date line.
    """
    reach = reach_km if isinstance(reach_km, Column) else F.lit(float(reach_km))
    n_lon = int(360 / bin_degrees)
    dlat = reach / KM_A_DEGREE
    top = F.abs(F.col("lat")) + dlat  # towards a pole within reach every longitude may be near
    dlon = F.when(top >= 89.0, 180.0).otherwise(F.least(reach / (KM_A_DEGREE * F.cos(F.radians(top))), F.lit(180.0)))
    lat_bins = F.sequence(bin_of(F.col("lat") - dlat, bin_degrees), bin_of(F.col("lat") + dlat, bin_degrees))
    first, last = bin_of(F.col("lon") - dlon, bin_degrees), bin_of(F.col("lon") + dlon, bin_degrees)
    lon_bins = F.transform(F.sequence(first, F.least(last, first + n_lon - 1)), lambda b: F.pmod(b, F.lit(n_lon)))
    dealt = (
        tracks.withColumn("__reach", reach).withColumn("__y", F.explode(lat_bins)).withColumn("__x", F.explode(lon_bins))
    )
    placed = cells.withColumns({
        "__y": bin_of(F.col("cell_lat"), bin_degrees), "__x": F.pmod(bin_of(F.col("cell_lon"), bin_degrees), F.lit(n_lon))
    })
    pairs = dealt.join(placed, [*on, "__y", "__x"])
    d = distance_km(F.col("cell_lat"), F.col("cell_lon"), F.col("lat"), F.col("lon"), wrap=False)  # it is periodic, and reducing a longitude rounds it
    return pairs.withColumn("dist_km", d).filter(F.col("dist_km") <= F.col("__reach")).drop("__x", "__y", "__reach")


def positions_near_land(tracks: DataFrame, land: DataFrame, reach_km: Column, keys: list[str], bin_degrees: float = 5.0) -> DataFrame:
    """Positions with some land cell within their reach (a semi-join by distance)."""
    near = storm_cells(tracks, land, reach_km, bin_degrees).select(*keys).distinct()
    return tracks.join(near, keys, "left_semi")


def associate(steps: DataFrame, tracks: DataFrame, points: DataFrame, place: str, max_km: float | None = None) -> DataFrame:
    """Storms of each (declaration, place, time) step: distance, bearing, radius of the quadrant, number of storms.

    ``tracks`` has time, storm_id, lat, lon and radii; ``points`` the place with place_lat, place_lon.
    """
    joined = steps.join(tracks, "time").join(points, place, "left")
    bearing = bearing_deg(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon"))
    out = joined.withColumns({
        "dist_km": distance_km(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon"), EARTH_RADIUS_CASES_KM, wrap=False),
        "r_quad_km": radius_of(quadrant_of_bearing(bearing), F.col("radii")),
    })
    out = out.withColumn("inside", F.coalesce(F.col("dist_km") <= F.col("r_quad_km"), F.lit(False)))
    return out if max_km is None else out.filter(F.col("dist_km") <= max_km)


def nearest(df: DataFrame, keys: list[str], distance: str, ties: list[str]) -> DataFrame:
    """The row of least distance of each group (then by ``ties``), and how many rows the group has."""
    w = Window.partitionBy(*keys)
    return (
        df.withColumn("n_active", F.count("*").over(w))
        .withColumn("__rank", F.row_number().over(w.orderBy(F.asc_nulls_last(distance), *ties)))
        .filter("__rank = 1").drop("__rank")
    )


def nearest_storms(steps: DataFrame, tracks: DataFrame, points: DataFrame, place: str, max_km: float | None = None) -> DataFrame:
    """Steps with the storm nearest to their place at their time (see ``associate``), found once a place and time."""
    each = associate(steps.select(place, "time").distinct(), tracks, points, place, max_km)
    return steps.join(nearest(each, [place, "time"], "dist_km", ["storm_id"]), [place, "time"])


def nearest_in_time(targets: DataFrame, series: DataFrame, keys: list[str], tolerance_seconds: int, target_time: str = "target_time", time: str = "time") -> DataFrame:
    """For each target the row of the series nearest in time within the tolerance; the earlier one of a tie.

    Times are binned by the tolerance: a target meets its own bin and the two beside it. Targets without a row are
    left out (see ``without_match``). ``targets`` has a column target_id. gap_s is in seconds, with fractions.
    """
    width = max(1, tolerance_seconds)
    dealt = targets.withColumn("__bin", F.explode(F.array(*(bucket(F.col(target_time), width) + k for k in (-1, 0, 1)))))
    joined = dealt.join(series.withColumn("__bin", bucket(F.col(time), width)), [*keys, "__bin"])
    gap = F.abs(micros(F.col(target_time)) - micros(F.col(time))) / MICROS
    w = Window.partitionBy(*keys, "target_id").orderBy("gap_s", time)
    return (
        joined.withColumn("gap_s", gap).filter(F.col("gap_s") <= tolerance_seconds)
        .withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank", "__bin")
    )


def synoptic_targets(targets: DataFrame, target_time: str = "target_time") -> DataFrame:
    """``targets``; a time that is not synoptic is an error when it is read."""
    t = F.col(target_time)
    message = F.concat(F.lit("not a synoptic time: "), t.cast("string"))
    return targets.withColumn(target_time, F.when(is_synoptic(t), t).otherwise(F.raise_error(message).cast(targets.schema[target_time].dataType)))


def exact_in_time(
    targets: DataFrame, series: DataFrame, keys: list[str], target_time: str = "target_time", time: str = "time", synoptic_only: bool = False
) -> DataFrame:
    """For each target the row of its very time; ``synoptic_only`` makes other targets an error."""
    targets = synoptic_targets(targets, target_time) if synoptic_only else targets
    return targets.withColumn(time, F.col(target_time)).join(series, [*keys, time])


def without_match(targets: DataFrame, matched: DataFrame, key: str = "target_id") -> DataFrame:
    return targets.join(matched, key, "left_anti")


def with_cloud_radii(track: DataFrame, cloud: DataFrame) -> DataFrame:
    return track.join(cloud, ["storm_id", "time"], "left")


def on_grid(df: DataFrame, other: DataFrame, tolerance: float = 1e-3, lat: str = "lat", lon: str = "lon", wrap: bool = True) -> DataFrame:
    """Left join of a grid with another of the same points, whose coordinates may differ by rounding."""
    return near_grid(df, other, tolerance, lat, lon, wrap)


#: Words that a name may have or lack.
SMALL_WORDS = ("de", "del", "la", "las", "los", "el")


def find_place(places: DataFrame, wanted: DataFrame, fallback: str | None = None, suggestions: int = 15) -> DataFrame:
    """``wanted`` with code, how, hits and similar: places by comparable name within their state.

    ``places``: code, name, state; ``wanted``: wanted_id, wanted, state and others. A place of the same name, else one that has
    all words of the wanted name (but ``SMALL_WORDS``), if there is one alone: how is exact or words. Where none has, the
    column ``fallback`` names a code that is taken if there is such a place (how: code). All others have no code: how is
    several or none, and similar has up to ``suggestions`` names of the state that hold the first word.

    Names are looked up once each, by equality and by an inverted index of words; nothing pairs the names of a state. Places of one
    name count together, so that work and memory grow with the distinct names and not with the places that share them.
    """
    from galerna.functions.text import comparable

    small = F.array(*map(F.lit, SMALL_WORDS))
    spelled = places.groupBy("state", "name").agg(F.count("*").alias("__n"), F.min("code").alias("code")).withColumn("__own", comparable(F.col("name")))
    own = spelled.groupBy("state", "__own").agg(F.sum("__n").alias("__places"), F.min("code").alias("code"))
    names = wanted.select("state", "wanted").distinct().withColumn("__name", comparable(F.col("wanted")))
    words = F.array_except(F.array_distinct(F.split("__name", " ")), F.concat(small, F.array(F.lit(""))))
    asked = names.select("state", "__name").distinct().withColumn("__words", words)
    one = lambda how: (F.sum("__places").alias("hits"), F.min("code").alias("code"), F.lit(how).alias("how"))
    exact = asked.join(own.withColumnRenamed("__own", "__name"), ["state", "__name"]).groupBy("state", "__name").agg(*one("exact"))
    left = asked.join(exact, ["state", "__name"], "left_anti")
    index = own.select("state", "__own", "code", "__places", F.explode(F.array_distinct(F.split("__own", " "))).alias("__word"))
    posted = left.select("state", "__name", F.size("__words").alias("__n"), F.explode("__words").alias("__word")).join(index, ["state", "__word"])
    met = posted.groupBy("state", "__name", "__own").agg(*(F.first(c).alias(c) for c in ("code", "__places", "__n")), F.count("*").alias("__met")).filter("__met = __n")
    # a name of small words alone is met by every place of its state
    bare = left.filter(F.size("__words") == 0).select("state", "__name").join(own.select("state", "code", "__places"), "state")
    by_words = met.select("state", "__name", "code", "__places").unionByName(bare).groupBy("state", "__name").agg(*one("words"))
    found = exact.unionByName(by_words)
    missed = asked.join(found.filter("hits = 1"), ["state", "__name"], "left_anti").withColumn("__first", F.split("__name", " ")[0])
    listed = missed.select("state", "__first").distinct().join(spelled, "state").filter(F.contains("__own", F.col("__first")))
    listed = listed.withColumn("__again", F.explode(F.array_repeat(F.lit(0), F.least("__n", F.lit(suggestions)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("state", "__first").orderBy("name"))
    listed = listed.withColumn("__rank", rank).filter(F.col("__rank") <= suggestions).groupBy("state", "__first").agg(F.array_sort(F.collect_list("name")).alias("similar"))
    similar = missed.join(listed, ["state", "__first"]).select("state", "__name", "similar")
    answers = names.join(found, ["state", "__name"], "left").join(similar, ["state", "__name"], "left").drop("__name")
    out = wanted.join(answers, ["state", "wanted"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    single, code, how = F.col("hits") == 1, F.col("code"), F.col("how")
    if fallback:
        codes = places.select(F.col("code").alias("__code")).distinct()
        out = out.join(codes, F.col(fallback) == F.col("__code"), "left")
        taken = (F.col("hits") == 0) & F.col("__code").isNotNull()
        single, code, how = single | taken, F.when(taken, F.col("__code")).otherwise(code), F.when(taken, "code").otherwise(how)
    missing = F.when(F.col("hits") > 1, "several").otherwise("none")
    return out.withColumns({
        "code": F.when(single, code), "how": F.when(single, how).otherwise(missing), "similar": F.when(~single, F.coalesce("similar", F.array().cast("array<string>")))
    }).drop("__code")


def require_places(found: DataFrame) -> DataFrame:
    """What ``find_place`` has found; names that have not one place each are an error that lists some of them."""
    bad = found.filter("code is null").orderBy("wanted_id").select("wanted", "state", "hits", "similar").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.wanted} ({r.state}): {r.hits} places, similar: {', '.join(r.similar) or '-'}" for r in bad))
    return found


def scan_lines(polygons: DataFrame, cells: DataFrame, band_degrees: float = 0.25) -> DataFrame:
    """(place, cell_lat, west, east): the stretches inside a polygon along the latitudes of the cells, west <= lon < east.

    ``polygons``: place, rings (array of rings of (lat, lon), closed or not; islands and holes alike, by the even-odd rule). Edges and
    latitudes are dealt to bands and joined there, so that an edge meets only the latitudes that it crosses, and a latitude's
    crossings with a polygon are sorted once for all of its cells.
    """
    following = lambda ring: F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = polygons.select("place", F.explode("rings").alias("ring")).filter(F.size("ring") > 0)
    edges = edges.select("place", F.explode(F.arrays_zip(F.col("ring").alias("p"), following(F.col("ring")).alias("q"))).alias("e")).select("place", "e.p", "e.q")
    low, high = F.least("p.lat", "q.lat"), F.greatest("p.lat", "q.lat")
    bands = F.explode(F.sequence(bin_of(low, band_degrees), bin_of(high, band_degrees)))
    dealt = edges.filter("p.lat <> q.lat").withColumn("band", bands)
    lats = cells.select("cell_lat").distinct().withColumn("band", bin_of(F.col("cell_lat"), band_degrees))
    y = F.col("cell_lat")
    # an edge holds its lower end and not its upper one, so that a vertex on the line counts once or twice as it must
    crossed = dealt.join(lats, "band").filter((y >= low) & (y < high))
    x = F.col("p.lon") + (y - F.col("p.lat")) * (F.col("q.lon") - F.col("p.lon")) / (F.col("q.lat") - F.col("p.lat"))
    lines = crossed.groupBy("place", "cell_lat").agg(F.array_sort(F.collect_list(x)).alias("x"))
    at = F.filter(F.sequence(F.lit(0), F.size("x") - 1), lambda k: k % 2 == 0)
    spans = F.explode(F.transform(at, lambda k: F.struct(F.get("x", k).alias("west"), F.get("x", k + 1).alias("east"))))
    return lines.select("place", "cell_lat", spans.alias("s")).select("place", "cell_lat", "s.west", "s.east").filter("west < east")


def inside_cells(polygons: DataFrame, cells: DataFrame, bin_degrees: float = 1.0, wrap: bool = True) -> DataFrame:
    """(place, cell): cells whose centre lies inside a polygon. A ring over the date line goes on beyond 180 (or -180) degrees, and
    meets cells around the globe; without ``wrap`` only those of the very longitudes."""
    n_lon = int(360 / bin_degrees)
    first, last = bin_of(F.col("west"), bin_degrees), bin_of(F.col("east"), bin_degrees)
    if not wrap:
        spans = scan_lines(polygons, cells).withColumn("__x", F.explode(F.sequence(first, last)))
        placed = cells.select("cell", "cell_lat", "cell_lon", bin_of(F.col("cell_lon"), bin_degrees).alias("__x"))
        met = spans.join(placed, ["cell_lat", "__x"]).filter((F.col("west") <= F.col("cell_lon")) & (F.col("cell_lon") < F.col("east")))
        return met.select("place", "cell").distinct()
    bins = F.transform(F.sequence(first, F.least(last, first + n_lon - 1)), lambda b: F.pmod(b, F.lit(n_lon)))
    spans = scan_lines(polygons, cells).withColumn("__x", F.explode(bins))
    placed = cells.select("cell", "cell_lat", "cell_lon", F.pmod(bin_of(F.col("cell_lon"), bin_degrees), F.lit(n_lon)).alias("__x"))
    lon = F.col("west") + F.pmod(F.col("cell_lon") - F.col("west"), F.lit(360.0))
    return spans.join(placed, ["cell_lat", "__x"]).filter((F.col("cell_lon") == F.col("west")) | (lon < F.col("east"))).select("place", "cell").distinct()


def polygon_cells(polygons: DataFrame, cells: DataFrame, staging: Staging, wrap: bool = True) -> DataFrame:
    """(place, cell, n_centres): cells whose centre lies inside a polygon; one without any takes the nearest cell, however far.

    ``polygons``: place, place_lat, place_lon, rings (see ``scan_lines``). ``wrap``: see ``inside_cells``; the nearest cell is sought
    around the globe in any case.
    """
    inside = staging("inside", inside_cells(polygons, cells, wrap=wrap))
    counted = inside.join(inside.groupBy("place").agg(F.count("*").cast("int").alias("n_centres")), "place")
    lonely = polygons.join(inside.select("place").distinct(), "place", "left_anti").select("place", F.col("place_lat").alias("lat"), F.col("place_lon").alias("lon"))
    return counted.unionByName(nearest_cells(lonely, cells, staging).withColumn("n_centres", F.lit(0)))


def in_polygons(cells: DataFrame, polygons: DataFrame) -> DataFrame:
    """Cells with ``inside``: whether their centre lies in some polygon (a country's mask)."""
    found = inside_cells(polygons, cells).select("cell", F.lit(True).alias("inside")).distinct()
    return cells.join(found, "cell", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


#: Half the length of a meridian circle, beyond which no point lies, and bins whose number goes round the globe evenly.
FARTHEST_KM, BINS = 20_100.0, (1.0, 2.0, 5.0, 10.0, 20.0, 45.0, 90.0)


def nearest_cells(points: DataFrame, cells: DataFrame, staging: Staging, reach_km: float = 100.0) -> DataFrame:
    """(place, cell): the nearest cell of each point (place, lat, lon), the smaller cell of a tie; no rows without cells.

    Points meet the cells within a reach, all of them, so that the nearest of these is the nearest of all. Points that meet
    none are tried again with twice the reach and wider bins, until all have one: a row is paired with no cell beyond
    twice its distance.
    """
    parts, rest, turn = [], staging("lonely-0", points.select("place", "lat", "lon")), 0
    while True:
        bins = next((b for b in BINS if b * KM_A_DEGREE * 4 >= reach_km), BINS[-1])
        pairs = storm_cells(rest, cells, min(reach_km, FARTHEST_KM), bins)
        parts.append(staging(f"nearest-{turn}", pairs.groupBy("place").agg(F.min_by("cell", F.struct("dist_km", "cell")).alias("cell"))))
        turn += 1
        rest = staging(f"lonely-{turn}", rest.join(parts[-1], "place", "left_anti"))
        if reach_km >= FARTHEST_KM or rest.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        reach_km *= 2


def near_grid(df: DataFrame, other: DataFrame, tolerance: float = 1e-3, lat: str = "lat", lon: str = "lon", wrap: bool = True) -> DataFrame:
    """Left join of two grids whose coordinates agree within ``tolerance`` degrees: each row of ``df`` gets the nearest point.

    Points meet in bins as wide as the tolerance, the row's own and the eight beside it, so that no edge of a bin parts two
    points. The smaller latitude, then longitude, of a tie; longitudes agree around the date line, or as they are without ``wrap``. Columns of ``other``
    named like one of ``df`` (but its coordinates) are an error. A row without a point within reach has NULLs.
    """
    clash = ({*df.columns} & {*other.columns}) - {lat, lon}
    if clash:
        raise ValueError(f"both grids have {', '.join(sorted(clash))}")
    n_lon = round(360 / tolerance)
    number = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    around = lambda b: F.pmod(b, F.lit(n_lon)) if wrap else b
    beside = F.array(*map(F.lit, (-1, 0, 1)))
    points = df.select(F.col(lat).alias("__lat"), F.col(lon).alias("__lon")).distinct()
    dealt = points.withColumn("__di", F.explode(beside)).withColumn("__dj", F.explode(beside))
    dealt = dealt.withColumns({"__i": number("__lat") + F.col("__di"), "__j": around(number("__lon") + F.col("__dj"))})
    right = other.withColumns({"__i": number(lat), "__j": around(number(lon))})
    apart = F.col("__lon") - F.col(lon)
    dy, dx = F.abs(F.col("__lat") - F.col(lat)), F.abs(longitude_difference(apart) if wrap else apart)
    # a millionth of the tolerance for the rounding of coordinates
    near = dealt.join(right, ["__i", "__j"]).filter((dy <= tolerance * (1 + 1e-6)) & (dx <= tolerance * (1 + 1e-6)))
    values = [c for c in other.columns if c not in (lat, lon)]
    best = near.groupBy("__lat", "__lon").agg(F.min_by(F.struct(*values), F.struct(dy * dy + dx * dx, F.col(lat), F.col(lon))).alias("__v"))
    same = (F.col(lat) == F.col("__lat")) & (F.col(lon) == F.col("__lon"))
    return df.join(best, same, "left").select(*df.columns, *(F.col(f"__v.{c}") for c in values))
