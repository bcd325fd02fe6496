"""A case study: a storm's positions near land, rain windows, index by experiment, values by municipality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galerna.operators import joins, municipal, rain
from galerna.plans import snapshot as S
from galerna.sources.staging import unstaged


def lacking_rain(tracks: DataFrame, series: DataFrame) -> DataFrame:
    """Positions whose time the rain series lacks: must be empty before a case is computed."""
    return tracks.join(series.select("time").distinct(), "time", "left_anti")


def cells_of(series: DataFrame, grid: DataFrame, climatology: DataFrame) -> DataFrame:
    """(cell, time, p6, r24, a72, cell_lat, cell_lon, q6, q24, q72)."""
    return rain.with_durations(series, ["cell"]).join(grid, "cell").join(climatology, "cell", "left")


def run(
    tracks: DataFrame, series: DataFrame, grid: DataFrame, climatology: DataFrame, bridge: DataFrame, settings: dict[str, S.Settings],
    lead_in_hours: int = 84, staged: Callable[[str, DataFrame], DataFrame] = unstaged,
) -> dict[str, DataFrame]:
    """fields, by_place, event, classes and rejected.

    ``staged`` gets what several products read: the positions near land (all bisections of the storm stage), the fields
    and the values by place; a ``Staging`` computes each once.
    """
    stage = staged("positions", S.storm_stage(tracks, next(iter(settings.values()))))
    usable = stage.filter("usable").select("storm_id", "time", "lat", "lon", "reach_km")
    near = staged("near", joins.positions_near_land(usable, grid, F.col("reach_km"), ["storm_id", "time"]))
    chosen = tracks.join(near.select("storm_id", "time"), ["storm_id", "time"], "left_semi")
    if not lacking_rain(near, series).isEmpty():
        raise ValueError("the rain lacks times of the track")
    first, last = near.agg(F.min("time"), F.max("time")).head()
    window = series.filter(F.col("time").between(F.lit(first) - F.expr(f"interval {lead_in_hours} hours"), F.lit(last))) if first else series.limit(0)
    fields = staged("fields", S.experiments(chosen, cells_of(window, grid, climatology), settings))
    by_place = staged("by_place", municipal.values(fields, bridge, ["experiment", "storm_id", "time"]))
    event = staged("event", municipal.event_maximum(by_place, ["experiment", "storm_id", "place"]))
    return {
        "fields": fields, "by_place": by_place, "event": event, "classes": municipal.class_counts(event, "experiment", list(settings)),
        "rejected": S.rejected_of(stage),
    }
