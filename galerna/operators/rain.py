"""Rain series by cell: accumulation, rolling sums, declustered peaks.

A series has a cell key, a time (window end) and a value; NULL is missing. Windows partition by cell (and season), so
that one exchange on the cell serves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galerna.constants import STEP_SECONDS, SYNOPTIC_HOURS
from galerna.functions.time import MICROS, is_synoptic, micros, season_window_ends, window_end


def hourly_sums(value: Column, time: Column, end: Column, order: Column, hours: int, label_is: str) -> tuple[list[Column], Column, Column]:
    """Aggregates of a window's values, the sum of them, and the number of hours that have one.

    Each hour is a bit; ``bit_or`` merges repeated hours, and of an hour's values the first by ``order`` counts.
    """
    late = micros(end) - micros(time) - F.lit((3600 if label_is == "start" else 0) * MICROS)
    hour = F.floor(late / (3600 * MICROS)).cast("int")  # a label within its hour belongs to that hour
    own = [value.isNotNull() & (hour == k) for k in range(hours)]
    firsts = [F.min_by(F.when(t, value), F.when(t, order)).alias(f"__h{k}") for k, t in enumerate(own)]
    bits = F.lit(0)
    for k, t in enumerate(own):
        bits = F.when(t, 1 << k).otherwise(bits)
    total = sum((F.coalesce(f"__h{k}", F.lit(0.0)) for k in range(hours)), F.lit(0.0))
    whole = F.col("__bits") == (1 << hours) - 1
    return [*firsts, F.bit_or(bits).alias("__bits")], F.when(whole, total), F.bit_count("__bits").cast("long")


def accumulate(
    hourly: DataFrame, keys: list[str], time: str = "time", value: str = "p", hours: int = 6, label_is: str = "start", order: str | None = None
) -> DataFrame:
    """Sum over (T - hours, T] of one value for each of its ``hours``; any missing hour gives NULL.

    NaN and negative values count as missing. A repeated hour counts once, with the first of its values by the column
    ``order`` (as their place in the input), else by time and size; n is the number of hours that have a value, so that an
    hour that comes twice never stands for one that lacks. Sums are partial before the one exchange.
    """
    x = F.col(value).cast("double")
    good = F.when(~F.isnan(x) & (x >= 0), x)
    end = window_end(F.col(time), hours, label_is)
    first = F.struct(*([order] if order else []), F.col(time), good)
    parts, total, n = hourly_sums(good, F.col(time), end, first, hours, label_is)
    return hourly.groupBy(*keys, end.alias("__end")).agg(*parts).select(*keys, F.col("__end").alias("time"), total.alias("p6"), n.alias("n"))


def with_season_spine(cells: DataFrame, years: list[int], series: DataFrame, keys: list[str]) -> DataFrame:
    """All window ends of the seasons for all cells, with the series where it has them."""
    spine = cells.withColumn("season", F.explode(F.array(*map(F.lit, years))))
    spine = spine.withColumn("time", F.explode(season_window_ends(F.col("season"))))
    return spine.join(series, [*keys, "time"], "left")


def gap_filled(series: DataFrame, keys: list[str], time: str = "time", step_seconds: int = STEP_SECONDS) -> DataFrame:
    """The series on its regular axis from first to last step; steps that lack are NULL rows.

    A time off the axis of its group, or one that comes twice, is an error and names it.
    """
    span = series.groupBy(*keys).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    step = F.expr(f"interval {step_seconds} seconds")
    axis = span.select(*keys, F.explode(F.sequence("a", "b", step)).alias(time))
    w = Window.partitionBy(*keys).orderBy(time)
    gap = micros(F.col(time)) - micros(F.lag(time).over(w))
    wrong = F.coalesce((gap == 0) | (F.pmod(gap, F.lit(step_seconds * MICROS)) != 0), F.lit(False))
    message = F.concat(F.lit("a time off its axis: "), F.col(time).cast("string"))
    checked = series.withColumn("__wrong", wrong).withColumn(time, F.when(F.col("__wrong"), F.raise_error(message).cast(series.schema[time].dataType)).otherwise(F.col(time)))
    return axis.join(checked.drop("__wrong"), [*keys, time], "left")


def _span(keys: list[str], time: str, first: int, last: int):
    """Rows whose time lies between ``first`` and ``last`` microseconds from the row's."""
    return Window.partitionBy(*keys).orderBy(micros(F.col(time))).rangeBetween(first, last)


def rolling_sum(value: str, keys: list[str], hours: int, time: str = "time", exclusive: bool = False, step_seconds: int = STEP_SECONDS) -> Column:
    """Sum of the last ``hours``, this step included (or excluded); NULL unless all steps are there.

    The frame is a range of time, so that a gap leaves too few steps in it.
    """
    n = hours * 3600 // step_seconds
    first, last = (-n * step_seconds, -step_seconds) if exclusive else (-(n - 1) * step_seconds, 0)
    w = _span(keys, time, first * MICROS, last * MICROS)
    return F.when(F.count(value).over(w) == n, F.sum(value).over(w))


def with_durations(series: DataFrame, keys: list[str], value: str = "p6", time: str = "time") -> DataFrame:
    """Add r24, r72 (inclusive) and a72 (the 72 h before)."""
    return series.withColumns({
        "r24": rolling_sum(value, keys, 24, time), "r72": rolling_sum(value, keys, 72, time),
        "a72": rolling_sum(value, keys, 72, time, exclusive=True),
    })


def declustered(series: DataFrame, keys: list[str], separation_hours: int, value: str = "r", time: str = "time", threshold: float = 1.0) -> DataFrame:
    """Peaks of at least ``threshold`` that exceed all values in the separation before and none after (the first of a
    tie wins); missing neighbours are ignored."""
    s = separation_hours * 3600 * MICROS
    before = F.max(value).over(_span(keys, time, -s, -1))
    after = F.max(value).over(_span(keys, time, 1, s))
    low = F.lit(float("-inf"))
    return (
        series.withColumns({"__before": F.coalesce(before, low), "__after": F.coalesce(after, low)})
        .filter((F.col(value) >= threshold) & (F.col(value) > F.col("__before")) & (F.col(value) >= F.col("__after")))
        .drop("__before", "__after")
    )


def synoptic(df: DataFrame, time: str = "time", hours: tuple[int, ...] = SYNOPTIC_HOURS) -> DataFrame:
    return df.filter(is_synoptic(F.col(time), hours))


def in_box(df: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float, pad: float = 0.0, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Bounds are inclusive; the predicate reaches the Parquet scan. A box over the date line is an error."""
    if lon_min > lon_max:
        raise ValueError("the box crosses the date line")
    return df.filter(F.col(lat).between(lat_min - pad, lat_max + pad) & F.col(lon).between(lon_min - pad, lon_max + pad))
