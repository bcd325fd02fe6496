"""Fields by municipality: values, classes, counts, lead times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galerna.constants import LEAD_LEVELS, LEAD_WINDOW_HOURS
from galerna.functions.basic import hazard_class_filled
from galerna.functions.time import MICROS, micros


def values(field: DataFrame, bridge: DataFrame, keys: list[str], place: str = "place", value: str = "h_total") -> DataFrame:
    """Maximum, mean and 90th percentile (linear) over the cells of each place; a missing value counts as 0."""
    x = F.coalesce(F.col(value), F.lit(0.0))
    return (
        field.join(bridge, "cell").groupBy(place, *keys)
        .agg(F.max(x).alias("v_max"), F.avg(x).alias("v_mean"), F.percentile(x, F.lit(0.9)).alias("v_p90"))
    )


def event_maximum(by_time: DataFrame, keys: list[str], value: str = "v_max") -> DataFrame:
    return by_time.groupBy(*keys).agg(F.max(value).alias("event_max"))


def event_of_fields(field: DataFrame, bridge: DataFrame, keys: list[str], place: str = "place", value: str = "h_total") -> DataFrame:
    """event_max and in_region (whether some cell was ever within the direct or indirect region) by place and ``keys``, in one group."""
    x = F.coalesce(F.col(value), F.lit(0.0))
    inside = F.bool_or(F.col("m_direct") | F.col("m_indirect"))
    return field.join(bridge, "cell").groupBy(place, *keys).agg(F.max(x).alias("event_max"), inside.alias("in_region"))


def class_counts(event: DataFrame, experiment: str, tags: list[str], value: str = "event_max") -> DataFrame:
    """Rows by class 1..5 and a column for each experiment; zeros where there is none."""
    classes = event.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("class"))
    counted = (
        event.withColumn("class", hazard_class_filled(F.col(value))).filter("class > 0")
        .groupBy("class").pivot(experiment, tags).count()
    )
    return classes.join(counted, "class", "left").select("class", *(F.coalesce(F.col(t), F.lit(0)).cast("long").alias(t) for t in tags))


def ordinal_table(event: DataFrame, declared: DataFrame, experiment: str, place: str, value: str = "event_max") -> DataFrame:
    """By experiment and class 0..5: places inside the region at some step, those declared, and their share."""
    flagged = event.join(declared.select(place).distinct().withColumn("__declared", F.lit(True)), place, "left")
    inside = flagged.filter("in_region").withColumn("class", hazard_class_filled(F.col(value)))
    counted = inside.groupBy(experiment, "class").agg(F.count("*").alias("places"), F.count_if(F.coalesce("__declared", F.lit(False))).alias("declared"))
    grid = event.select(experiment).distinct().withColumn("class", F.explode(F.array(*map(F.lit, range(6)))))
    n, d = F.coalesce("places", F.lit(0)), F.coalesce("declared", F.lit(0))
    return grid.join(counted, [experiment, "class"], "left").select(
        experiment, "class", n.alias("places"), d.alias("declared"), F.try_divide(d, n).alias("share")
    )


def peak_time(field: DataFrame, land: DataFrame, keys: list[str], value: str = "h_total", time: str = "time") -> DataFrame:
    """For each key the time of the largest sum over land cells, the first on ties."""
    total = field.join(land, "cell", "left_semi").groupBy(*keys, time).agg(F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("total"))
    w = Window.partitionBy(*keys).orderBy(F.desc("total"), time)
    return total.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def first_declared(declared: DataFrame, keys: list[str], start: str, offset_hours: int = 6) -> DataFrame:
    """Earliest start of each place, local midnight as UTC."""
    return declared.groupBy(*keys).agg(F.timestamp_micros(micros(F.min(start)) + offset_hours * 3600 * MICROS).alias("first_start"))


def lead_times(
    series: DataFrame, events: DataFrame, keys: list[str], klass: str = "class", time: str = "time",
    levels: tuple[int, ...] = LEAD_LEVELS, window_hours: float = LEAD_WINDOW_HOURS, step_hours: int = 6,
) -> DataFrame:
    """For each event (keys, t_event) and level: first time of the window at the level, start and end of the last
    unbroken episode, and the hours from both to the event. Levels never reached are rows of NULLs.

    Episodes are islands of equal difference between time and its rank.
    """
    grid = events.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    t, e = micros(F.col(time)), micros(F.col("t_event"))
    hits = series.join(grid, keys).filter((t <= e) & (t >= e - int(window_hours * 3600 * MICROS)) & (F.col(klass) >= F.col("level")))
    w = Window.partitionBy(*keys, "t_event", "level").orderBy(time)
    island = t - F.row_number().over(w) * F.lit(step_hours * 3600 * MICROS)
    episodes = (
        hits.withColumn("__island", island).groupBy(*keys, "t_event", "level", "__island").agg(F.min(time).alias("a"), F.max(time).alias("b"))
    )
    found = episodes.groupBy(*keys, "t_event", "level").agg(
        F.min("a").alias("first_time"), F.max_by("a", "b").alias("episode_start"), F.max("b").alias("episode_end")
    )
    hours = lambda c: (micros(F.col("t_event")) - micros(F.col(c))) / (3600 * MICROS)
    return grid.join(found, [*keys, "t_event", "level"], "left").select(
        *keys, "t_event", "level", "first_time", "episode_start", "episode_end",
        hours("episode_start").alias("lead_h"), hours("episode_end").alias("since_end_h"),
    )


def painted(by_place: DataFrame, bridge: DataFrame, place: str, value: str) -> DataFrame:
    """(cell, value): a place's value on its cells; places with centres inside win over nearest-cell ones, then the
    larger place key."""
    joined = bridge.join(by_place, place)
    return joined.groupBy("cell").agg(F.max_by(value, F.struct(F.col("n_centres") > 0, F.col(place))).alias(value))
