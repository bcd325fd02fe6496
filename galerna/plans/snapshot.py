"""The hazard snapshot: storm positions and cells to the index, as one plan for all positions and experiments.

The storm stage works on positions alone (radii, profile parameters, bisections); cells meet positions by bins of place
and by time; the rest are expressions on the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galerna.constants import KNOT_MS, QUADRANTS
from galerna.functions import geometry as G
from galerna.functions import hazard as H
from galerna.functions import radii as R
from galerna.functions import wind as V
from galerna.functions.basic import pinned, positive
from galerna.operators.joins import storm_cells
from galerna.operators.sets import over_all_cores, stacked


@dataclass(frozen=True)
class Settings:
    """Options of one experiment."""

    matrix: H.RainMatrix = field(default_factory=H.RainMatrix)
    mode: str = "floor"
    r34_unit: str = "nm"
    cloud_unit: str = "km"
    direct_fallback_km: float | None = None
    profile_fallback: bool = True
    tail_end_kt: float = 12.0 / KNOT_MS
    rain_missing: float | None = 0.0
    alpha: float = 1.0
    beta: float = 1.0
    lam: float = 1.0
    mu: float = 1.0
    whole_grid: bool = False
    wrap: bool = True  # quadrants over the date line; else longitudes count as they are


def _struct(df: DataFrame, prefix: str) -> Column:
    have = set(df.columns)
    return F.struct(*((F.col(f"{prefix}{q}") if f"{prefix}{q}" in have else F.lit(None)).cast("double").alias(q) for q in QUADRANTS))


def storm_stage(tracks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Positions with radii and profile. ``usable`` is false where vmax or a radius cannot be had.

    tracks: storm_id, time, lat, lon, vmax_kt, and where known rmw_km, r34_<quadrant>, rocloud_<quadrant>.
    """
    return _attributed(_positions(tracks, s), lambda *radii: R.attribution_radius(*radii, s.mode))


def _positions(tracks: DataFrame, s: Settings) -> DataFrame:
    """The storm stage up to the choice of the attribution radius.

    Positions are few but cost thousands of steps each, so they are dealt to all cores whatever their bytes.
    """
    tracks = over_all_cores(tracks)
    have = set(tracks.columns)
    vmax = positive(F.col("vmax_kt").cast("double"))
    rmw = positive(F.col("rmw_km").cast("double")) if "rmw_km" in have else F.lit(None).cast("double")
    out = pinned(
        tracks, vmax=vmax, rmw=rmw, r34=G.radii_in_km(_struct(tracks, "r34_"), s.r34_unit), cloud=G.radii_in_km(_struct(tracks, "rocloud_"), s.cloud_unit)
    )
    out = pinned(
        out, r34_mean=G.mean_positive(F.col("r34")), reference=F.when(F.col("vmax").isNotNull(), V.reference_radii(F.col("vmax"), F.col("lat")))
    )
    fallback = F.lit(s.direct_fallback_km).cast("double")
    if s.profile_fallback:
        fallback = F.coalesce(fallback, F.col("reference.r34_km"))
    out = pinned(out, direct=R.direct_radius(F.col("r34"), F.col("vmax"), F.coalesce("rmw", F.col("reference.rmax_km")), fallback))
    outer = G.uniform(F.col("reference.r_outer_km"))
    known = F.col("direct").isNotNull() & F.col("reference.r_outer_km").isNotNull()
    out = pinned(out, r_w06=F.when(known, R.at_least(outer, F.col("direct.radii"))))
    storm = F.when(F.col("r_w06").isNotNull(), V.calibrated_storm(F.col("vmax"), F.col("lat"), F.col("rmw"), F.col("r34_mean")))
    return pinned(out, storm=storm)


def _attributed(positions: DataFrame, attribution) -> DataFrame:
    """``attribution`` maps cloud, outer and direct radii to the attribution radius."""
    radius = attribution(F.col("cloud"), F.col("r_w06"), F.col("direct.radii"))
    out = pinned(positions, attribution=F.when(F.col("r_w06").isNotNull(), radius))
    return pinned(
        out, usable=F.col("vmax").isNotNull() & F.col("attribution").isNotNull(), reach_km=R.largest(F.col("attribution.radii"), F.col("r_w06"))
    )


def hazards(pairs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Fields of the pairs of ``storm_stage`` positions and cells.

    Cells carry cell, cell_lat, cell_lon, p6, r24, a72 and maps q6, q24, q72 of quantiles by name (Q75, ...).
    """
    names = sorted({*s.matrix.nodes, *(x for pair in s.matrix.escalation.values() for x in pair if x)})
    quantiles = {k: {n: F.try_element_at(F.col(m), F.lit(n)) for n in names} for k, m in (("p6", "q6"), ("r24", "q24"), ("a72", "q72"))}
    rain = s.matrix.hazard(F.col("p6"), quantiles["p6"], {"r24": F.col("r24"), "a72": F.col("a72")}, quantiles)
    out = pinned(pairs, quadrant=G.quadrant(F.col("cell_lat"), F.col("cell_lon"), F.col("lat"), F.col("lon"), s.wrap))
    radius = lambda c: G.radius_of(F.col("quadrant"), F.col(c))
    out = pinned(out, r_direct=radius("direct.radii"), r_attr=radius("attribution.radii"), r_w06_q=radius("r_w06"), h_p=rain)
    out = out.withColumn("h_p_missing", F.col("h_p").isNull())
    if s.rain_missing is not None:
        out = out.withColumn("h_p", F.coalesce("h_p", F.lit(float(s.rain_missing))))
    out = pinned(out, wind=V.hazard_with_tail(F.col("dist_km"), F.col("r_direct"), F.col("r_w06_q"), F.col("storm"), s.tail_end_kt))
    masks = H.masks(F.col("dist_km"), F.col("r_direct"), F.col("r_attr"))
    out = out.withColumns({"h_w": F.col("wind.h_w"), "wind_kt": F.col("wind.wind_kt"), **masks})
    parts = H.components(F.col("h_p"), F.col("h_w"), {m: F.col(m) for m in masks}, s.alpha, s.beta, s.lam, s.mu)
    return out.withColumns(parts).drop("wind")


def snapshot(tracks: DataFrame, cells: DataFrame, s: Settings = Settings(), on: tuple[str, ...] = ("time",)) -> DataFrame:
    """Storm positions against the cells of the same time.

    Only cells within the largest radius of a position come out (elsewhere the index is 0); with ``whole_grid`` every
    cell of the time does.
    """
    return hazards(_paired(storm_stage(tracks, s).filter("usable"), cells, s, on), s)


def _paired(positions: DataFrame, cells: DataFrame, s: Settings, on: tuple[str, ...]) -> DataFrame:
    if s.whole_grid:
        d = G.distance_km(F.col("cell_lat"), F.col("cell_lon"), F.col("lat"), F.col("lon"))
        return positions.join(cells, list(on)).withColumn("dist_km", d)
    return storm_cells(positions, cells, F.col("reach_km"), on=on)


def rejected_of(stage: DataFrame) -> DataFrame:
    """Positions of a storm stage that have no snapshot, and why."""
    reason = F.when(F.col("vmax").isNull(), "no wind").when(F.col("direct").isNull(), "no direct radius").otherwise("no attribution radius")
    return stage.filter(~F.col("usable")).select("storm_id", "time", reason.alias("reason"))


def rejected(tracks: DataFrame, s: Settings = Settings()) -> DataFrame:
    return rejected_of(storm_stage(tracks, s))


def experiments(tracks: DataFrame, cells: DataFrame, settings: dict[str, Settings], on: tuple[str, ...] = ("time",)) -> DataFrame:
    """Snapshots by experiment. Where settings differ in their mode alone, profiles are computed and cells are joined
    once: the experiment is a column from the choice of the attribution radius on."""
    first = next(iter(settings.values()))
    if any(replace(s, mode=first.mode) != first for s in settings.values()):
        return stacked({k: snapshot(tracks, cells, s, on) for k, s in settings.items()}, "experiment")

    def attribution(*radii: Column) -> Column:
        out = F.lit(None)
        for name, s in settings.items():
            out = F.when(F.col("experiment") == name, R.attribution_radius(*radii, s.mode)).otherwise(out)
        return out

    positions = _positions(tracks, first).withColumn("experiment", F.explode(F.array(*map(F.lit, settings))))
    return hazards(_paired(_attributed(positions, attribution).filter("usable"), cells, first, on), first)
