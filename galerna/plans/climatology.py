"""Climatologies of rain: percentiles of wet windows and return periods, for all cells and durations in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galerna.constants import GEV_MIN_SEASONS, GPD_MIN_EXCESSES, QUANTILES, SEPARATION_HOURS, WET_MM
from galerna.functions import extremes as E
from galerna.operators import extremes, quantiles, rain
from galerna.operators.quality import with_units
from galerna.operators.selection import quantiles as quantiles_of
from galerna.operators.sets import stacked
from galerna.sources.staging import Staging, unstaged


def durations(series: DataFrame, hours: tuple[int, ...] = (6, 24, 72), keys: tuple[str, ...] = ("cell", "season")) -> DataFrame:
    """(keys, time, duration, r): rolling sums of p6 in long form; windows do not reach over seasons."""
    sums = series.withColumns({f"d{h}": rain.rolling_sum("p6", list(keys), h) for h in hours})
    pairs = F.explode(F.array(*(F.struct(F.lit(h).alias("duration"), F.col(f"d{h}").alias("r")) for h in hours)))
    return sums.select(*keys, "time", pairs.alias("d")).select(*keys, "time", "d.duration", "d.r")


def wet_percentiles(series: DataFrame, hours: tuple[int, ...] = (6, 24, 72), levels: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Percentiles, frequencies and shares of the wet windows by cell and duration."""
    long = durations(series, hours).repartition("cell")
    parts = {}
    for h in hours:
        own, keys = long.filter(F.col("duration") == h), ["cell"]
        p = quantiles.wet(own, keys, "r", h, levels)
        parts[str(h)] = quantiles.frequencies(own, keys, "r", h).join(p, keys, "left").join(quantiles.share_above(own, p, keys, "r", levels), keys, "left")
    return stacked(parts, "duration_h").withColumn("duration_h", F.col("duration_h").cast("int"))


def return_periods(
    series: DataFrame, k: int, hours: tuple[int, ...] = (6, 24, 72), min_n: int = GEV_MIN_SEASONS, min_excess: int = GPD_MIN_EXCESSES,
    staged: Callable[[str, DataFrame], DataFrame] = unstaged,
) -> dict[str, DataFrame]:
    """maxima, top, gev, gpd, gev_levels, pot_levels and empirical_levels by (cell, duration).

    Rolling sums, maxima, largest peaks and fits are handed to ``staged``: with a ``Staging`` each is computed once, however
    many of the products are written, and the series is read once.
    """
    keys = ["cell", "duration"]
    long = staged("durations", durations(series.repartition("cell"), hours))
    maxima = staged("maxima", extremes.seasonal_maximum(long, keys, "r", time="time"))  # absent steps count as missing
    peaks = [
        rain.declustered(long.filter(F.col("duration") == h), ["cell", "season", "duration"], SEPARATION_HOURS[h], "r", threshold=WET_MM) for h in hours
    ]
    every = peaks[0]
    for p in peaks[1:]:
        every = every.unionByName(p)
    top = staged("top", extremes.top_k(every, keys, "r", k + 1, ["time"]))
    seasons = maxima.filter(F.col("maximum").isNotNull()).groupBy(*keys).agg(F.count("*").alias("n_seasons"))
    gev = staged("gev", extremes.gev_fits(maxima, keys, "maximum", min_n))
    gpd = staged("gpd", extremes.gpd_fits(top, seasons, keys, "r", min_excess))
    return {
        "maxima": maxima, "top": top, "gev": gev, "gpd": gpd, "gev_levels": extremes.gev_levels(gev, keys), "pot_levels": extremes.pot_levels(gpd, keys),
        "empirical_levels": extremes.empirical_levels(top.filter(F.col("rank") <= k), seasons, keys, "r", k),
    }


#: The largest median and 90th percentile of the absolute relative difference of two good estimators.
CONSISTENT = (0.05, 0.12)


def consistency(
    gev: DataFrame, gpd: DataFrame, keys: list[str], by: list[str], staging: Staging, years: float = 10.0, criteria: tuple[float, float] = CONSISTENT
) -> DataFrame:
    """By ``by``: median and 90th percentile of the absolute relative difference POT - GEV of the same annual period, its bias
    (median), and whether the criteria are met; of the cells (``keys``) that both fits know, with a positive GEV level."""
    g = gev.select(*keys, E.gev_level(F.lit(years), F.col("xi"), F.col("sigma"), F.col("mu")).alias("gev"))
    p = gpd.select(*keys, E.pot_level(E.recurrence(F.lit(years)), F.col("u"), F.col("sigma"), F.col("xi"), F.col("rate")).alias("pot"))
    both = g.join(p, keys).filter("gev > 0 and pot is not null").withColumn("r", (F.col("pot") - F.col("gev")) / F.col("gev"))
    r = F.col("r")
    out = quantiles_of(both, by, {"median": (F.abs(r), 0.5), "p90": (F.abs(r), 0.9), "bias": (r, 0.5)}, staging)
    return out.withColumn("meets", (F.col("median") <= criteria[0]) & (F.col("p90") <= criteria[1]))


#: Units by the first letters of a product's column; rain is that of the row's duration.
UNITS = {"n_": "1", "share": "1", "freq": "1", "wet_": "1", "area": "1", "q": "mm", "p": "mm", "r": "mm", "maximum": "mm", "level": "mm", "u": "mm", "sigma": "mm", "mu": "mm", "xi": "1", "rate": "1/season"}


def with_product_units(df: DataFrame) -> DataFrame:
    """``df`` with the unit of each column that holds a quantity, as metadata that Parquet keeps."""
    def unit(name: str) -> str | None:
        return next((u for start, u in UNITS.items() if name == start or (name.startswith(start) and (start.endswith("_") or name[len(start)].isdigit() or name[len(start)] == "_"))), None)

    numbers = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "bigint", "long", "integer", "int")}
    return with_units(df, {c: u for c in df.columns if c in numbers and (u := unit(c))})


def as_views(products: dict[str, DataFrame], prefix: str) -> list[str]:
    """The products of a run as temporary views <prefix>_<name>, for SQL on what is computed; their names."""
    for name, df in products.items():
        df.createOrReplaceTempView(f"{prefix}_{name}")
    return [f"{prefix}_{name}" for name in products]
