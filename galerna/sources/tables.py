"""Readers and writers. Rasters come as Parquet in long form: one row for each cell and time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galerna.constants import NAUTICAL_MILE_KM, QUADRANTS
from galerna.functions.basic import non_negative, pinned, positive
from galerna.functions.geometry import km_in
from galerna.functions.text import any_of, code5, column_name, quoted_name
from galerna.functions.time import is_synoptic, micros

FORMATS = {".csv": "csv", ".parquet": "parquet", ".orc": "orc", ".json": "json", ".txt": "text", ".dat": "text", ".dot": "text"}
RAIN_NAMES = ("precipitation", "precip", "tp", "rain", "pr")
TIME_NAMES = ("valid_time", "time")
LAT_NAMES, LON_NAMES = ("lat", "latitude", "y"), ("lon", "longitude", "x")

TRACK = T.StructType([
    T.StructField("storm_id", T.StringType()), T.StructField("time", T.TimestampType()), T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()), T.StructField("vmax_kt", T.DoubleType()), T.StructField("pmin_hpa", T.DoubleType()),
    T.StructField("rmw_km", T.DoubleType()), *(T.StructField(f"r34_{q}", T.DoubleType()) for q in QUADRANTS),
])


def format_of(path: str) -> str:
    suffix = "." + path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"no reader for {path}")
    return FORMATS[suffix]


def read(spark: SparkSession, path: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """By suffix. CSV files have a header unless told otherwise."""
    kind = format_of(path)
    reader = spark.read.format(kind).options(**({"header": True} | options if kind == "csv" else options))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def first_name(df: DataFrame, names: tuple[str, ...], given: str | None = None, only: bool = False) -> str:
    """The given column, else the first candidate there, else (if ``only``) the only column."""
    found = [n for n in ((given,) if given else names) if n in df.columns]
    if found:
        return found[0]
    if only and not given and len(df.columns) == 1:
        return df.columns[0]
    raise ValueError(f"none of {given or names} among {df.columns}")


#: Millimetres an hour in a unit of hourly rain.
RAIN_UNITS = {
    "mm": 1.0, "mm/h": 1.0, "mm h-1": 1.0, "mm hr-1": 1.0, "mm/hr": 1.0, "mm/hour": 1.0, "kg m-2": 1.0, "kg m**-2": 1.0, "m": 1000.0,
    "kg m-2 s-1": 3600.0, "kg m**-2 s**-1": 3600.0, "mm/s": 3600.0, "mm s-1": 3600.0,
}


def rain_factor(unit: str | None) -> float:
    """What makes hourly rain of a unit millimetres; rain without a unit is in millimetres, and an unknown one is an error."""
    if unit is None or not unit.strip():
        return 1.0
    if unit.strip().lower() not in RAIN_UNITS:
        raise ValueError(f"unknown unit of rain: {unit}")
    return RAIN_UNITS[unit.strip().lower()]


def rain(
    df: DataFrame, value: str | None = None, time: str | None = None, synoptic_only: bool = True, unit: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(valid_time, lat, lon, precipitation, and columns ``keep``): names inferred, NaN and negative values missing, longitudes
    to -180..180, hourly values of another ``unit`` in millimetres."""
    value, time = first_name(df, RAIN_NAMES, value), first_name(df, TIME_NAMES, time)
    lat, lon = first_name(df, LAT_NAMES), first_name(df, LON_NAMES)
    if time != "valid_time" and "valid_time" in df.columns:
        raise ValueError("column valid_time exists already")
    x = F.col(value).cast("double") * rain_factor(unit)
    out = df.select(
        F.col(time).cast("timestamp").alias("valid_time"), F.col(lat).cast("double").alias("lat"),
        F.when(F.col(lon) > 180, F.col(lon) - 360).otherwise(F.col(lon)).cast("double").alias("lon"),
        F.when(~F.isnan(x), non_negative(x)).alias("precipitation"), *keep,
    )
    return out.filter(is_synoptic(F.col("valid_time"))) if synoptic_only else out


def rain_files(spark: SparkSession, folder: str, pattern: str = "*.nc*") -> DataFrame:
    """(path, modificationTime, length) of a folder's files, sorted by path; sub-folders are not looked into."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    return found.select("path", "modificationTime", "length").orderBy("path")


def label_convention(time: Column, low: Column, high: Column) -> Column:
    """start or end: the bound of its interval that a label lies on, within a quarter of the width; else an error."""
    t, a, b = micros(time), micros(low), micros(high)
    to_low, to_high, room = F.abs(t - a), F.abs(t - b), (b - a) / 4
    near = F.when((to_low <= to_high) & (to_low < room), "start").when((to_high < to_low) & (to_high < room), "end")
    return F.coalesce(near, F.raise_error(F.concat(F.lit("a label within its interval: "), time.cast("string"))).cast("string"))


def seasons(df: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """Rows of the years' seasons; a year without any is an error."""
    own = df.filter(F.col("season").isin(*years))
    lacking = sorted(set(years) - {r[0] for r in own.select("season").distinct().collect()})  # a row for each year
    if lacking:
        raise ValueError(f"no rain of {lacking}")
    return own


def associated(spark: SparkSession, path: str) -> DataFrame | None:
    """Declarations with their storms, as the declaration plan writes them; None where there are none yet."""
    try:
        found = spark.read.option("header", True).csv(path)
    except AnalysisException:
        return None
    return found.withColumn("place", code5(F.col("place")))


def standardized(df: DataFrame, renamed: dict[str, str] | None = None) -> DataFrame:
    """Lower-case underscore names, then canonical ones by a map canonical -> source."""
    df = df.toDF(*(column_name(c) for c in df.columns))
    return df.withColumnsRenamed({column_name(v): k for k, v in (renamed or {}).items() if column_name(v) in df.columns})


def tracks(df: DataFrame, renamed: dict[str, str] | None = None, required: tuple[str, ...] = ("storm_id", "time", "lat", "lon")) -> DataFrame:
    """A track table with its columns cast; values that are no numbers are missing. No order is imposed."""
    df = standardized(df, renamed)
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise KeyError(f"a track lacks {', '.join(absent)}")

    def cast(f: T.StructField) -> Column:
        return F.col(f.name).try_cast(f.dataType).alias(f.name)

    known = {f.name for f in TRACK}
    return df.select(*(cast(f) for f in TRACK if f.name in df.columns), *(c for c in df.columns if c not in known))


def best_tracks(df: DataFrame, rmw_unit: str = "nm") -> DataFrame:
    """Storms with arrays over time (sid, iso_time, lat, lon, usa_wind, usa_pres, usa_rmw, usa_r34 of arrays) to rows.

    Texts may be bytes, or arrays of single characters (bytes). Rows without time or place go; the radius of maximum wind becomes km, 34-kt radii stay nm in
    the order north-east, south-east, south-west, north-west.
    """
    def text(c: Column, kind: T.DataType) -> Column:
        return F.trim(F.array_join(F.transform(c, lambda x: x.cast("string")), "") if isinstance(kind, T.ArrayType) else c.cast("string"))

    zipped = F.arrays_zip(*(F.col(c) for c in ("iso_time", "lat", "lon", "usa_wind", "usa_pres", "usa_rmw", "usa_r34")))
    rows = df.select(text(F.col("sid"), df.schema["sid"].dataType).alias("storm_id"), F.posexplode(zipped).alias("step", "r"))
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    out = rows.select(
        "storm_id", F.try_to_timestamp(text(F.col("r.iso_time"), df.schema["iso_time"].dataType.elementType)).alias("time"), number("r.lat").alias("lat"), number("r.lon").alias("lon"),
        number("r.usa_wind").alias("vmax_kt"), number("r.usa_pres").alias("pmin_hpa"), (number("r.usa_rmw") * km_in(rmw_unit)).alias("rmw_km"),
        *(F.get(F.col("r.usa_r34"), F.lit(k)).cast("double").alias(f"r34_{q}") for k, q in enumerate(QUADRANTS)),
    )
    return out.na.drop(subset=["time", "lat", "lon"])


def storm_arrays(df: DataFrame, storm_id: str) -> DataFrame:
    """The one row (arrays over time) of a storm; none, or an id that repeats, is an error when it is read."""
    from galerna.operators.tracks import exactly_one

    return exactly_one(df.filter(F.trim(F.col("sid").cast("string")) == storm_id), f"storm {storm_id}")


def one_storm(df: DataFrame, storm_id: str) -> DataFrame:
    """Rows of a storm; none is an error when the rows are read."""
    own = df.filter(F.col("storm_id") == storm_id)
    found = own.agg(F.count("*").alias("n")).filter(F.assert_true(F.col("n") > 0, f"no storm {storm_id}").isNull())
    return own.join(F.broadcast(found.select(F.lit(storm_id).alias("storm_id"))), "storm_id")


#: Fields of a line of the two cloud-radius text layouts, in their order there.
CLOUD_FLAT = ("dd", "mm", "yy", "hh", "lat", "lon", "vmax", "pmin", "rne", "rnw", "rsw", "rse", "mean", "asymmetry", "dispersion", "solidity", "storm_id")
CLOUD_BLOCK = (
    "date", "hh", "lat", "lon", "vmax", "pmin", "rne", "rnw", "rsw", "rse", "mean", "asymmetry", "dispersion", "solidity",
    "rbp_rne", "rbp_rnw", "rbp_rsw", "rbp_rse", "rbp_mean",
)
MISSING = -9999.0


def _number(c: Column) -> Column:
    return F.nullif(c.try_cast("double"), F.lit(MISSING))


def cloud_flat(lines: DataFrame, separator: str = r"\s+") -> DataFrame:
    """Lines (value) of 17 fields split on white space (or another pattern); -9999 is missing."""
    f = F.split(F.trim("value"), separator)
    rows = lines.filter(F.trim("value") != "").select(F.when(F.size(f) == len(CLOUD_FLAT), f).otherwise(
        F.raise_error(F.concat(F.lit("not 17 fields: "), F.col("value"))).cast("array<string>")).alias("f"))
    names = {n: F.col("f")[k] for k, n in enumerate(CLOUD_FLAT)}
    part = lambda n: names[n].try_cast("int")
    time = F.make_timestamp(part("yy"), part("mm"), part("dd"), F.when(part("hh") < 100, part("hh")).otherwise(F.floor(part("hh") / 100).cast("int")), F.lit(0), F.lit(0))
    return rows.select(
        names["storm_id"].alias("storm_id"), time.alias("time"), _number(names["lat"]).alias("lat"), _number(names["lon"]).alias("lon"),
        _number(names["vmax"]).alias("vmax_kt"), _number(names["pmin"]).alias("pmin_hpa"), _number(names["mean"]).alias("rocloud_mean_km"),
        *(_number(names[q]).alias(f"rocloud_{q}") for q in QUADRANTS), *(_number(names[n]).alias(n) for n in ("asymmetry", "dispersion", "solidity")),
    )


def cloud_comma(lines: DataFrame) -> DataFrame:
    """Lines of 17 fields with commas and the wind in km/h: vmax_kt_cloud in knots; radii that are not positive are missing."""
    out = cloud_positive(cloud_flat(lines, r"\s*,\s*"))
    return out.withColumn("vmax_kt_cloud", F.col("vmax_kt") / NAUTICAL_MILE_KM).drop("vmax_kt")


def _is_header(fields: Column) -> Column:
    return (F.size(fields) >= 3) & F.trim(fields[2]).try_cast("int").isNotNull() & ~F.trim(fields[0]).try_cast("double").isNotNull()


def is_block_layout(files: DataFrame) -> DataFrame:
    """(path, is_block) of whole files: whether the first line that is not blank is a block's header."""
    first = F.get(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != ""), F.lit(0))
    return files.select("path", F.coalesce(_is_header(F.split(first, ",")), F.lit(False)).alias("is_block"))


def cloud_blocks(files: DataFrame) -> DataFrame:
    """Whole files (path, value: all text) of blocks: a header ``id, name, n,`` and rows of 19 fields that it heads.

    A header applies to the lines after it, in its file. A row before any header, or of another length, is an error
    that names its line. record_number counts from 1 in each block, found_entries are the block's rows.
    """
    numbered = F.transform(F.split("value", r"\r?\n"), lambda text, k: F.struct(k.alias("line"), text.alias("text")))
    lines = pinned(files.select("path", "value"), lines=F.filter(numbered, lambda x: F.trim(x["text"]) != ""))
    # a file is one row: its lines are cut at their headers there, without an exchange or a sort
    at = F.filter(F.transform("lines", lambda x, k: F.when(_is_header(F.split(x["text"], ",")), k)), lambda k: k.isNotNull())
    starts = pinned(lines, starts=F.concat(F.array(F.lit(-1)), at, F.array(F.size("lines"))))

    def block(k: Column) -> Column:
        start, end = F.get("starts", k), F.get("starts", k + 1)
        first = F.get("lines", start)
        head = F.split(first["text"], ",")
        header = F.struct(first["line"].alias("at"), F.trim(head[0]).alias("storm_id"), F.trim(head[1]).alias("storm_name"), F.trim(head[2]).cast("int").alias("declared"))
        return F.struct(F.when(start >= 0, header).alias("header"), F.slice("lines", start + 2, end - start - 1).alias("rows"))

    blocks = starts.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size("starts") - 2), block)).alias("b"))
    rows = blocks.select("path", "b.header", F.size("b.rows").cast("long").alias("found_entries"), F.posexplode("b.rows").alias("k", "row"))
    rows = rows.select("path", "header", "found_entries", "k", "row.line", "row.text")
    f = F.split(F.trim("text"), r"[\s,]+")
    where = F.concat(F.lit("line "), (F.col("line") + 1).cast("string"))
    checked = F.when(F.col("header").isNull(), F.raise_error(F.concat(where, F.lit(" has no header"))).cast("array<string>")).when(
        F.size(f) != len(CLOUD_BLOCK), F.raise_error(F.concat(where, F.lit(" has not 19 fields"))).cast("array<string>")
    ).otherwise(f)
    out = rows.select("path", "line", "header", "found_entries", checked.alias("f"), (F.col("k") + 1).alias("record_number"))
    names = {n: F.col("f")[k] for k, n in enumerate(CLOUD_BLOCK)}
    hhmm, date = names["hh"].try_cast("int"), names["date"]
    time = F.make_timestamp(F.substring(date, 1, 4).cast("int"), F.substring(date, 5, 2).cast("int"), F.substring(date, 7, 2).cast("int"),
                            F.when(hhmm < 100, hhmm).otherwise(F.floor(hhmm / 100).cast("int")), F.lit(0), F.lit(0))
    return out.select(
        "path", F.col("header.at").alias("block"), F.col("header.storm_id").alias("storm_id"), F.col("header.storm_name").alias("storm_name"), F.col("header.declared").alias("declared_entries"),
        "found_entries", "record_number", time.alias("time"), _number(names["lat"]).alias("lat"), _number(names["lon"]).alias("lon"),
        _number(names["vmax"]).alias("vmax_kt"), _number(names["pmin"]).alias("pmin_hpa"), _number(names["mean"]).alias("rocloud_mean_km"),
        *(_number(names[q]).alias(f"rocloud_{q}") for q in QUADRANTS), *(_number(names[n]).alias(n) for n in CLOUD_BLOCK[11:]),
    )


def wrong_counts(blocks: DataFrame) -> DataFrame:
    """Blocks whose number of rows is not the declared one."""
    each = blocks.groupBy("path", "block", "storm_id").agg(F.first("declared_entries").alias("declared"), F.count("*").alias("found"))
    return each.filter("declared <> found")


def checked_counts(blocks: DataFrame) -> DataFrame:
    """The blocks, or an error that lists all whose number of rows is not the declared one."""
    wrong = wrong_counts(blocks).orderBy("path", "block").collect()  # a row for each wrong block
    if wrong:
        raise ValueError("; ".join(f"{r.storm_id}: declared {r.declared}, found {r.found}" for r in wrong))
    return blocks


def cloud_texts(files: DataFrame, synoptic_only: bool = False, check: bool = False) -> DataFrame:
    """Whole block files read, checked if asked, put in standard names and, if asked, cut to synoptic times."""
    out = cloud_blocks(files)
    out = standardized(checked_counts(out) if check else out)
    return out.filter(is_synoptic(F.col("time"))) if synoptic_only else out


def cloud_positive(df: DataFrame) -> DataFrame:
    """Radii that are not positive mean no detection."""
    return df.withColumns({f"rocloud_{q}": positive(F.col(f"rocloud_{q}")) for q in QUADRANTS})


#: Words of the declarations' texts.
CYCLONE_WORDS = ("ciclon tropical", "huracan", "tormenta tropical", "depresion tropical")
RAIN_WORDS = ("lluvia", "inundacion", "remocion", "deslave", "deslizamiento")
EVENT_CLASS = "Hidrometeorológico"


def declarations(df: DataFrame, years: tuple[int, int] | None = None, rain_only: bool = False) -> DataFrame:
    """(id_decl, place, storm_name, kind, start, end, mentions_rain, ...) of cyclone declarations, from raw columns
    id, class, notes, place_code, kind, start, end (day first)."""
    from galerna.operators.declarations import with_dates

    text = F.col("notes")
    day = lambda c: F.try_to_timestamp(F.col(c), F.lit("d/M/yyyy"))
    out = df.filter((F.col("class") == EVENT_CLASS) & any_of(text, CYCLONE_WORDS)).select(
        F.col("id").cast("long").alias("id_decl"), code5(F.col("place_code")).alias("place"), quoted_name(text).alias("storm_name"), "kind",
        day("start").alias("start"), day("end").alias("end"), any_of(text, RAIN_WORDS).alias("mentions_rain"),
    )
    out = with_dates(out)
    if years:
        out = out.filter(F.year("start").between(*years))
    return out.filter("mentions_rain") if rain_only else out


def declarations_csv(spark: SparkSession, path: str, renamed: dict[str, str], **options) -> DataFrame:
    """``declarations`` of a CSV file in Latin-1; ``renamed`` maps the raw columns' names there to those here."""
    raw = spark.read.options(header=True, encoding="ISO-8859-1", multiLine=True, escape='"').csv(path)
    return declarations(raw.select(*(F.col(f"`{theirs}`").alias(ours) for theirs, ours in renamed.items())), **options)


def cloud_tracks(parts: list[DataFrame]) -> DataFrame:
    """Cloud-radius tables of several basins as one: synoptic hours only, radii that are not positive missing."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return cloud_positive(out.filter(is_synoptic(F.col("time"))))


def write(df: DataFrame, path: str, overwrite: bool = True, partition_by: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> None:
    """By suffix; Parquet for a path without one. The commit protocol makes the write all or nothing."""
    kind = FORMATS.get("." + path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower(), "parquet") if "." in path.rsplit("/", 1)[-1] else "parquet"
    df = df.select(*include) if include else df
    df = df.drop(*exclude) if exclude else df
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").format(kind)
    if kind == "csv":
        writer = writer.options(header=True, compression="gzip")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_seasons(df: DataFrame, path: str, value: str = "p6") -> None:
    """Rain by season, rounded to 0.01 mm; only the seasons at hand are replaced."""
    place = [c for c in ("cell", "lat", "lon") if c in df.columns]
    (
        df.withColumn(value, F.round(value, 2)).repartition("season", *place).sortWithinPartitions("season", *place, "time").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)
    )


def check_apart(source: str, target: str) -> None:
    """A target inside its source is an error."""
    if f"{target.rstrip('/')}/".startswith(f"{source.rstrip('/')}/"):
        raise ValueError("the output lies inside the source")
