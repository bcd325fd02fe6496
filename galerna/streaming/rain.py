"""Rain as a stream: 6-hour sums that close with the watermark, and rain episodes as sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galerna.functions.time import window_end
from galerna.operators.rain import hourly_sums


def accumulate(stream: DataFrame, key: str, time: str = "ts", value: str = "p", late: str = "3 hours", hours: int = 6) -> DataFrame:
    """(key, time, p6, n) with the window end as time, of hourly values labelled by the beginning of their hour.

    As in the batch operator NaN and negative values are missing, a repeated hour counts once (its first time, then its
    smallest value), and p6 is NULL unless all ``hours`` have a value. In append mode a window comes out once, when the
    watermark has passed it; its state is a value and a bit for each hour, however often hours repeat.
    """
    x = F.col(value).cast("double")
    good = F.when(~F.isnan(x) & (x >= 0), x)
    end = window_end(F.col(time), hours)
    parts, total, n = hourly_sums(good, F.col(time), end, F.struct(F.col(time), good), hours, "start")
    summed = stream.withWatermark(time, late).groupBy(key, F.window(time, f"{hours} hours").alias("w")).agg(*parts)
    return summed.select(key, F.col("w.end").alias("time"), total.alias("p6"), n.alias("n"))


def episodes(stream: DataFrame, key: str, time: str = "ts", value: str = "p", gap: str = "6 hours", late: str = "3 hours") -> DataFrame:
    """(key, start, end, total, n): runs of values with no gap longer than ``gap``."""
    return (
        stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w"))
        .agg(F.sum(value).alias("total"), F.count("*").alias("n"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "n")
    )
