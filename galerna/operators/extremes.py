"""Seasonal maxima, largest peaks, L-moments and return levels by cell and duration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galerna.constants import MIN_VALID_FRACTION, PEAKS_A_SEASON, RECURRENCES, RETURN_PERIODS, STEP_SECONDS
from galerna.functions import extremes as E
from galerna.functions.time import MICROS, micros
from galerna.operators.selection import quantiles
from galerna.sources.staging import Staging


def seasonal_maximum(
    df: DataFrame, keys: list[str], value: str, season: str = "season", min_valid: float = MIN_VALID_FRACTION, time: str | None = None, step_seconds: int = STEP_SECONDS,
) -> DataFrame:
    """Maximum of each season; NULL where less than ``min_valid`` of its steps have a value.

    Steps are the group's rows or, where ``time`` is given, all steps from the season's first row to its last, of any group: the
    axis is common to all groups, so that one whose head or tail is absent has these steps missing.
    """
    x = F.col(value)
    own = df.groupBy(*keys, season).agg(F.max(x).alias("top"), F.count(x).alias("n_valid"), F.count("*").alias("rows"))
    if time:
        span = (F.max(micros(F.col(time))) - F.min(micros(F.col(time)))) / (step_seconds * MICROS) + 1
        own = own.drop("rows").join(df.groupBy(season).agg(F.round(span).cast("long").alias("rows")), season)
    top = F.when(F.col("n_valid") >= min_valid * F.col("rows"), F.col("top"))
    return own.select(*keys, season, top.alias("maximum"), "n_valid", F.col("rows").alias("n_rows"))


def top_k(peaks: DataFrame, keys: list[str], value: str, k: int, ties: list[str] | None = None) -> DataFrame:
    """The k largest of each group with their rank; the limit is applied before the exchange too."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), *(ties or []))
    return peaks.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def counts_at_least(peaks: DataFrame, thresholds: DataFrame, keys: list[str], value: str, names: list[str]) -> DataFrame:
    """Peaks that reach each of the thresholds ``names`` of their group; a missing threshold, or group, counts none."""
    joined = peaks.join(thresholds, keys, "left")
    return joined.groupBy(*keys).agg(*(F.count_if(F.col(value) >= F.col(n)).alias(f"n_{n}") for n in names))


def l_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """l1, l2, l3 and n of each group, by order statistics; NULL moments with fewer than 3 values."""
    x = F.col("__x")
    ranked = df.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("__x"), F.row_number().over(Window.partitionBy(*keys).orderBy(value)).cast("double").alias("__i")
    )
    i, n = F.col("__i"), F.col("n").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(x).alias("s0"), F.sum(x * (i - 1)).alias("s1"), F.sum(x * (i - 1) * (i - 2)).alias("s2")
    )
    b0 = F.col("s0") / n
    b1 = F.col("s1") / F.nullif(n * (n - 1), F.lit(0.0))
    b2 = F.col("s2") / F.nullif(n * (n - 1) * (n - 2), F.lit(0.0))
    ok = F.col("n") >= 3
    return sums.select(
        *keys, F.when(ok, b0).alias("l1"), F.when(ok, 2 * b1 - b0).alias("l2"), F.when(ok, 6 * b2 - 6 * b1 + b0).alias("l3"), "n"
    )


def gev_fits(maxima: DataFrame, keys: list[str], value: str = "maximum", min_n: int = 15) -> DataFrame:
    m = l_moments(maxima, keys, value)
    fit = E.gev(F.col("l1"), F.col("l2"), F.col("l3"), F.col("n"), min_n)
    return m.withColumn("gev", fit).select(*keys, "n", "gev.xi", "gev.sigma", "gev.mu", F.col("gev.clipped").alias("clipped"))


def gev_levels(fits: DataFrame, keys: list[str], periods: tuple[float, ...] = RETURN_PERIODS) -> DataFrame:
    """One row for each fit and return period: (keys, period, level)."""
    each = F.explode(F.array(*map(F.lit, periods)))
    return fits.withColumn("period", each).select(*keys, "period", E.gev_level(F.col("period"), F.col("xi"), F.col("sigma"), F.col("mu")).alias("level"))


def gpd_fits(top: DataFrame, seasons: DataFrame, keys: list[str], value: str, min_excess: int = 20) -> DataFrame:
    """GPD of the k largest peaks over the (k + 1)-th: (keys, u, xi, sigma, rate, clipped, n_excess).

    ``top`` holds ranks 1..k+1 of each group, ``seasons`` the number n_seasons of each group.
    """
    last = top.groupBy(*keys).agg(F.max("rank").alias("last"), F.min(value).alias("u"))
    excess = top.join(last, keys).filter(F.col("rank") < F.col("last")).withColumn("__e", F.col(value) - F.col("u"))
    m = l_moments(excess, keys, "__e").join(last.select(*keys, "u"), keys).join(seasons, keys)
    fit = E.gpd(F.col("l1"), F.col("l2"), F.col("n"), F.col("n_seasons"), min_excess)
    return m.withColumn("gpd", fit).select(
        *keys, F.when(F.col("gpd").isNotNull(), F.col("u")).alias("u"), "gpd.xi", "gpd.sigma", "gpd.rate", "gpd.clipped", F.col("n").alias("n_excess"), "n_seasons"
    )


def pot_levels(fits: DataFrame, keys: list[str], recurrences: tuple[float, ...] = RECURRENCES) -> DataFrame:
    each = F.explode(F.array(*map(F.lit, recurrences)))
    return fits.withColumn("recurrence", each).select(
        *keys, "recurrence", E.pot_level(F.col("recurrence"), F.col("u"), F.col("sigma"), F.col("xi"), F.col("rate")).alias("level")
    )


def empirical_levels(top: DataFrame, seasons: DataFrame, keys: list[str], value: str, k: int, recurrences: tuple[float, ...] = RECURRENCES) -> DataFrame:
    """Levels between ranked peaks: rank m = n_seasons / R, linear between ranks; NULL if m < 1 or m > k.

    Ranks that a group has not are missing, and so is a level that needs them.
    """
    m = F.col("__m")
    wanted = seasons.withColumn("recurrence", F.explode(F.array(*map(F.lit, recurrences)))).withColumn("__m", F.col("n_seasons") / F.col("recurrence"))
    low = F.floor(m)
    needed = wanted.filter((m >= 1) & (m <= k)).withColumn("rank", F.explode(F.array_distinct(F.array(low, F.least(low + 1, F.lit(k))))))
    part = needed.join(top.select(*keys, "rank", value), [*keys, "rank"], "left")
    weight = F.when(F.col("rank") == low, 1 - (m - low)).otherwise(m - low)
    weight = F.when((low == k) & (F.col("rank") == k), F.lit(1.0)).otherwise(weight)
    lacking = F.count_if(F.col(value).isNull() & (weight > 0))
    levels = part.groupBy(*keys, "recurrence").agg(F.when(lacking == 0, F.sum(weight * F.col(value))).alias("level"))
    return wanted.select(*keys, "recurrence").join(levels, [*keys, "recurrence"], "left")


def default_k(n_seasons: int) -> int:
    return round(PEAKS_A_SEASON * n_seasons)


def percentile_intervals(percentiles: DataFrame, fits: DataFrame, keys: list[str], names: list[str], counts: DataFrame | None = None) -> DataFrame:
    """(keys, percentile, years): the mean interval between independent peaks of each percentile or more.

    ``counts`` (keys and n_<name>: events a season) are used where given, else the peaks' distribution; below its threshold,
    where it tells nothing, the interval is marked by 0.1.
    """
    value = F.array(*(F.struct(F.lit(n).alias("percentile"), F.col(n).cast("double").alias("x")) for n in names))
    long = percentiles.select(*keys, F.explode(value).alias("p")).select(*keys, "p.percentile", "p.x")
    if counts is not None:
        rates = F.array(*(F.struct(F.lit(n).alias("percentile"), F.col(f"n_{n}").cast("double").alias("rate")) for n in names))
        per_year = counts.select(*keys, F.explode(rates).alias("c")).select(*keys, "c.percentile", "c.rate")
        years = F.when(F.col("rate") > 0, 1.0 / F.col("rate")).when(F.col("rate") == 0, F.lit(float("inf")))
        return long.join(per_year, [*keys, "percentile"], "left").select(*keys, "percentile", years.alias("years"))
    joined = long.join(fits.select(*keys, "u", "sigma", "xi", "rate"), keys, "left")
    years = F.when(F.col("x") < F.col("u"), 0.1).otherwise(E.pot_interval(F.col("x"), F.col("u"), F.col("sigma"), F.col("xi"), F.col("rate")))
    return joined.select(*keys, "percentile", years.alias("years"))


def summary(
    levels: DataFrame, fits: DataFrame, cells: DataFrame, by: list[str], staging: Staging, periods: tuple[float, ...] = (2.0, 5.0, 10.0, 25.0)
) -> DataFrame:
    """By duration (``by``): medians over all cells of the levels of some periods, and the share of cells with a tail fit.

    ``levels``: by, cell, period, level; ``fits``: by, cell, xi of the peaks' distribution (NULL or absent: none); ``cells``: all
    (by, cell) that count. A duration's levels are as many as cells: its medians are selected, not gathered.
    """
    own = levels.join(cells, [*by, "cell"], "left_semi")
    wanted = {f"level_{t:g}": (F.when(F.col("period") == t, F.col("level")), 0.5) for t in periods}
    known = fits.filter(F.col("xi").isNotNull()).select(*by, "cell", F.lit(1).alias("ok"))
    tails = cells.join(known, [*by, "cell"], "left").groupBy(*by).agg((100.0 * F.count("ok") / F.count("*")).alias("tail_percent"))
    return tails.join(quantiles(own, by, wanted, staging), by, "left")


def shape_summary(fits: DataFrame, by: list[str], staging: Staging) -> DataFrame:
    """By duration: median and standard deviation (of the population) of the shape, and the share of clipped ones."""
    spread = fits.groupBy(*by).agg(F.stddev_pop("xi").alias("sd"), F.avg(F.col("clipped").cast("double")).alias("clipped_share"))
    return quantiles(fits, by, {"median": (F.col("xi"), 0.5)}, staging).join(spread, by)
