"""Percentile climatologies.

Type 7 (linear) is Spark's ``percentile``. Type 8 (median unbiased) sorts within the group by a window and picks the two
order statistics by rank, so that no group is gathered into one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galerna.constants import ABSOLUTE_THRESHOLDS_MM, MIN_EXCEEDANCES, QUANTILES, WET_MM
from galerna.functions.basic import quantile_name


def column_of(q: float, prefix: str = "q") -> str:
    return f"{prefix}{100 * q:g}".replace(".", "_")


def check_levels(levels: tuple[float, ...]) -> tuple[float, ...]:
    if not levels or any(not 0 <= q <= 1 for q in levels):
        raise ValueError("quantile levels must lie in [0, 1]")
    return tuple(levels)


def type7(df: DataFrame, keys: list[str], value: str, levels: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """Columns q90, q95, ... of each group; NULL values are skipped."""
    levels = check_levels(levels)
    p = F.percentile(value, F.array(*map(F.lit, levels)))
    out = df.groupBy(*keys).agg(p.alias("__p"))
    return out.select(*keys, *(F.col("__p")[k].alias(column_of(q)) for k, q in enumerate(levels)))


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once: the error of the product, of halves of 26 bits, and that of the sum are added last."""
    def halves(x: Column) -> tuple[Column, Column]:
        wide = x * F.lit(134217729.0)
        return wide - (wide - x), x - (wide - (wide - x))

    (a1, a0), (b1, b0), product = halves(a), halves(b), a * b
    total = product + c
    rest = (product - (total - (total - product))) + (c - (total - product))
    return total + (rest + (((a1 * b1 - product) + a1 * b0 + a0 * b1) + a0 * b0))


def type7_by_rank(df: DataFrame, keys: list[str], value: str, levels: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """``type7`` for values that are compared with their quantiles: by ranks, as ``type8``, and low * (1 - d) + high * d rounded
    once, so that two neighbours a bit apart have the right one of them between them. ``F.percentile`` may go beyond both."""
    levels = check_levels(levels)
    ranked = df.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("__x"),
        F.row_number().over(Window.partitionBy(*keys).orderBy(value)).alias("__i"),
        F.count("*").over(Window.partitionBy(*keys)).alias("__n"),
    )
    position = {q: (F.col("__n") - 1) * F.lit(float(q)) for q in levels}
    at = lambda q, k: F.max(F.when(F.col("__i") == F.floor(position[q]) + k, F.col("__x")))
    ends = ranked.groupBy(*keys).agg(*(
        c.alias(f"__{end}{k}") for k, q in enumerate(levels) for end, c in (("low", at(q, 1)), ("high", at(q, 2)), ("d", F.max(position[q] - F.floor(position[q]))))
    ))

    def between(k: int) -> Column:
        low, high, d = (F.col(f"__{end}{k}") for end in ("low", "high", "d"))
        return F.when(d > 0, _fused(low, 1 - d, high * d)).otherwise(low)

    return ends.select(*keys, *(between(k).alias(column_of(q)) for k, q in enumerate(levels)))


def as_map(df: DataFrame, keys: list[str], levels: tuple[float, ...]) -> DataFrame:
    """Columns q75, ... as one map {Q75: ...}."""
    pairs = [x for q in levels for x in (F.lit(quantile_name(q)), F.col(column_of(q)))]
    return df.select(*keys, F.create_map(*pairs).alias("quantiles"))


def type8(df: DataFrame, keys: list[str], value: str, levels: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Columns n, q75, ... of each group: h = (n + 1/3) q + 1/3, linear between order statistics, clipped at the ends."""
    levels = check_levels(levels)
    ranked = df.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("__x"),
        F.row_number().over(Window.partitionBy(*keys).orderBy(value)).alias("__i"),
        F.count("*").over(Window.partitionBy(*keys)).alias("__n"),
    )

    def between(q: float) -> Column:
        """From the lower order statistic on, so that between two equal ones it is these."""
        h = F.least(F.greatest((F.col("__n") + F.lit(1 / 3)) * q + F.lit(1 / 3), F.lit(1.0)), F.col("__n").cast("double"))
        low, high = (F.max(F.when(F.col("__i") == F.floor(h) + k, F.col("__x"))) for k in (0, 1))
        return low + F.max(h - F.floor(h)) * (F.coalesce(high, low) - low)

    return ranked.groupBy(*keys).agg(F.max("__n").alias("n"), *(between(q).alias(column_of(q)) for q in levels))


def wet(df: DataFrame, keys: list[str], value: str, duration_h: int = 6, levels: tuple[float, ...] = QUANTILES, wet_mm: float = WET_MM) -> DataFrame:
    """Percentiles of the wet windows: n_wet, q* raw, and ok* where n_wet >= 10 (d / 6) / (1 - q), else NULL."""
    raw = type8(df.filter(F.col(value) >= wet_mm), keys, value, levels).withColumnRenamed("n", "n_wet")
    need = {q: MIN_EXCEEDANCES * (duration_h / 6) / (1 - q) for q in levels}
    return raw.withColumns({column_of(q, "ok"): F.when(F.col("n_wet") >= need[q] - 1e-9, F.col(column_of(q))) for q in levels})


def share_above(df: DataFrame, percentiles: DataFrame, keys: list[str], value: str, levels: tuple[float, ...] = QUANTILES, wet_mm: float = WET_MM) -> DataFrame:
    """share*: part of the wet windows' rain that fell in windows above (strictly) each percentile."""
    x = F.col(value)
    joined = df.filter(x >= wet_mm).select(*keys, value).join(percentiles, keys)
    total = F.nullif(F.sum(x), F.lit(0.0))
    return joined.groupBy(*keys).agg(
        *((F.coalesce(F.sum(F.when(x > F.col(column_of(q)), x)), F.lit(0.0)) / total).alias(column_of(q, "share")) for q in levels)
    )


def frequencies(df: DataFrame, keys: list[str], value: str, duration_h: int = 6, wet_mm: float = WET_MM) -> DataFrame:
    """n_valid, wet_freq and the frequency above (strictly) the duration's absolute thresholds."""
    x = F.col(value)
    n = F.nullif(F.count(x), F.lit(0))
    return df.groupBy(*keys).agg(
        F.count(x).alias("n_valid"), (F.count_if(x >= wet_mm) / n).alias("wet_freq"),
        *((F.count_if(x > t) / n).alias(f"above_{t}") for t in ABSOLUTE_THRESHOLDS_MM[duration_h]),
    )


def by_hour(df: DataFrame, cell: list[str], value: str, time: str = "time", levels: tuple[float, ...] = (0.75, 0.9, 0.95)) -> DataFrame:
    """Type-7 percentiles for each cell and for each cell and end hour (hour -1: all), by grouping sets in one pass."""
    rows = df.select(*cell, F.hour(time).alias("hour"), value)
    p = F.percentile(value, F.array(*map(F.lit, levels)))
    keys = [F.col(c) for c in cell]
    out = rows.groupingSets([keys, [*keys, F.col("hour")]], *keys, F.col("hour")).agg(p.alias("__p"), F.count(value).alias("n"), F.grouping("hour").alias("__all"))
    hour = F.when(F.col("__all") == 1, F.lit(-1)).otherwise(F.col("hour"))
    return out.select(*cell, hour.alias("hour"), "n", *(F.col("__p")[k].alias(column_of(q)) for k, q in enumerate(levels)))


def wet_by_hour(df: DataFrame, cell: list[str], value: str, time: str = "time", duration_h: int = 6, levels: tuple[float, ...] = QUANTILES, wet_mm: float = WET_MM) -> DataFrame:
    """``wet`` for each cell and end hour, and for each cell over all hours (hour -1): one pass over rows dealt to both."""
    rows = df.filter(F.col(value) >= wet_mm).select(*cell, value, F.explode(F.array(F.hour(time), F.lit(-1))).alias("hour"))
    return wet(rows, [*cell, "hour"], value, duration_h, levels, wet_mm)
