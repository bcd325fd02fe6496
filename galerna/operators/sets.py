"""Set operations on frames with keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stacked(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Frames one below the other, each with its name in column ``key``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.withColumn(key, F.lit(k)) for k, f in frames.items()))


def over_all_cores(df: DataFrame) -> DataFrame:
    """Few rows that cost much each, dealt to all cores whatever their bytes."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def missing_steps(series: DataFrame, keys: list[str], time: str, step_seconds: int) -> DataFrame:
    """Steps between first and last that a series lacks."""
    span = series.groupBy(*keys).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    axis = span.select(*keys, F.explode(F.sequence("a", "b", F.expr(f"interval {step_seconds} seconds"))).alias(time))
    return axis.join(series, [*keys, time], "left_anti")


def matched(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other, keys, "left_semi")


def unmatched(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other, keys, "left_anti")
