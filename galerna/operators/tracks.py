"""Track tables: storms by id or name, positions at a time, parametric radii."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galerna.constants import OUTER_MS, QUADRANTS, R34_MS, SYNOPTIC_HOURS
from galerna.functions import geometry, wind
from galerna.functions.basic import positive
from galerna.functions.time import MICROS, is_synoptic, micros, normalized_hour
from galerna.operators.joins import with_cloud_radii
from galerna.operators.sets import over_all_cores


def exactly_one(df: DataFrame, what: str) -> DataFrame:
    """The only row; none or several are an error when the result is read."""
    one = df.agg(F.count("*").alias("__n"), F.first(F.struct(*df.columns)).alias("__row"))
    message = F.concat(F.lit(f"{what}: "), F.col("__n").cast("string"), F.lit(" rows, one is needed"))
    return one.filter(F.assert_true(F.col("__n") == 1, message).isNull()).select("__row.*")


def storm_ids(tracks: DataFrame) -> DataFrame:
    return tracks.select("storm_id").distinct()


def storm_named(storms: DataFrame, name: str, season: int) -> DataFrame:
    """(storm_id) of the storm of a name and season; ``storms`` has storm_id, name and season, a row for each storm."""
    return exactly_one(storms.filter((F.trim("name") == name) & (F.col("season") == season)).select("storm_id"), f"{name} {season}")


def at_hours(df: DataFrame, hour: str = "hh", hours: tuple[int, ...] = SYNOPTIC_HOURS) -> DataFrame:
    """Rows whose hour (H, or HHMM with no minutes) is one of ``hours``."""
    return df.filter(normalized_hour(F.col(hour)).isin(*hours))


def position_at(tracks: DataFrame, storm_id: str, time: Column, tolerance_hours: float | None = None, id_column: str = "storm_id", time_column: str = "time") -> DataFrame:
    """The row of a storm at a time: exactly there, or the nearest within the tolerance (the earlier one of a tie).

    None, or several at the exact time, is an error. Cloud-radius tables have the same columns and serve as well.
    """
    own, t = tracks.filter(F.col(id_column) == storm_id), F.col(time_column)
    if tolerance_hours is None:
        return exactly_one(own.filter(t == time), f"{storm_id} at its time")
    gap = F.abs(micros(t) - micros(time))
    near = own.filter(gap <= int(tolerance_hours * 3600 * MICROS))
    first = near.agg(F.min_by(F.struct(*near.columns), F.struct(gap, t)).alias("r")).filter("r is not null").select("r.*")
    return exactly_one(first, f"{storm_id} within {tolerance_hours} h")


def with_parametric_radii(
    tracks: DataFrame, thresholds_ms: dict[str, float] | None = None, use_rmw: bool = False, calibrate: bool = False, r34_unit: str = "nm",
    rmw_unit: str = "km", variant: str = "w06", prefix: str = "w06_",
) -> DataFrame:
    """Add radii of the profile at the thresholds and its parameters, in columns of the prefix.

    The radius of maximum wind and the mean of the 34-kt radii that are not zero are used only where asked for.
    """
    have = set(tracks.columns)
    thresholds = thresholds_ms or {"r34_km": R34_MS, "r_outer_km": OUTER_MS}
    rmw = positive(F.col("rmw_km").cast("double")) * geometry.km_in(rmw_unit) if use_rmw and "rmw_km" in have else None
    r34 = None
    if calibrate:
        quadrants = F.struct(*((F.col(f"r34_{q}") if f"r34_{q}" in have else F.lit(None)).cast("double").alias(q) for q in QUADRANTS))
        r34 = geometry.mean_positive(geometry.radii_in_km(quadrants, r34_unit))
    out = over_all_cores(tracks).withColumn("__w", wind.parametric_radii(F.col("vmax_kt").cast("double"), F.col("lat").cast("double"), thresholds, rmw, r34, variant))
    names = (*thresholds, "rmax_km", "x1_km", "n", "a", "x1_calibrated")
    return out.select(*tracks.columns, *(F.col(f"__w.{n}").alias(f"{prefix}{n}") for n in names))


def case_track(best: DataFrame, cloud: DataFrame, storm_id: str, cloud_id: str) -> DataFrame:
    """Synoptic positions of a storm that have a wind, with parametric and cloud radii."""
    own = best.filter((F.col("storm_id") == storm_id) & is_synoptic(F.col("time"))).na.drop(subset=["vmax_kt", "lat", "lon"])
    radii = [c for c in cloud.columns if c.startswith("rocloud_")]
    return with_cloud_radii(
        with_parametric_radii(own, variant="pa21", prefix="pa21_"),
        cloud.filter(F.col("storm_id") == cloud_id).select(F.lit(storm_id).alias("storm_id"), "time", *radii),
    )
