"""Direct and attribution radii of a storm position, by quadrant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galerna.constants import QUADRANTS, TROPICAL_STORM_KT
from galerna.functions.basic import lit, positive
from galerna.functions.geometry import any_valid, filled, filled_quadrants, uniform

MODES = ("never", "fallback", "floor", "always")


def resolved(radii: Column, source: Column | str, quadrants: Column, fallback: bool) -> Column:
    return F.struct(radii.alias("radii"), lit(source).alias("source"), quadrants.alias("filled"), F.lit(fallback).alias("used_fallback"))


def direct_radius(r34: Column, vmax_kt: Column, rmw_km: Column, fallback_km: Column, threshold_kt: float = TROPICAL_STORM_KT) -> Column:
    """(radii, source, filled, used_fallback): the 34-kt radii, gaps filled by their mean; else below tropical-storm
    force the radius of maximum wind; else the fallback; NULL if nothing is known."""
    none = F.array().cast("array<string>")
    return (
        F.when(any_valid(r34), resolved(filled(r34), F.when(F.size(filled_quadrants(r34)) > 0, "r34_filled").otherwise("r34"), filled_quadrants(r34), False))
        .when((vmax_kt < threshold_kt) & (rmw_km >= 0), resolved(uniform(rmw_km), "rmw", none, True))
        .when(fallback_km >= 0, resolved(uniform(fallback_km), "fallback", none, True))
    )


def cloud_radii(r: Column) -> Column:
    """Cloud radii for attribution: zero means no detection."""
    return F.struct(*(positive(r[q]).alias(q) for q in QUADRANTS))


def attribution_radius(cloud: Column, reference: Column, direct: Column, mode: str = "floor") -> Column:
    """(radii, status, clipped): by quadrant the cloud radius and the reference radius, never below the direct one.

    never: cloud radii, gaps filled by their mean; fallback: the reference where there is no cloud radius; floor: that
    and never less than the reference; always: the reference.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    c, values, status = cloud_radii(cloud), {}, {}
    mean = filled(c)
    for q in QUADRANTS:
        own, ref = c[q], reference[q]
        if mode == "never":
            values[q], status[q] = mean[q], F.when(own.isNotNull(), "cloud").when(mean[q].isNotNull(), "cloud_mean")
        elif mode == "always":
            values[q], status[q] = ref, F.when(ref.isNotNull(), "reference")
        elif mode == "fallback":
            values[q] = F.coalesce(own, ref)
            status[q] = F.when(own.isNotNull(), "cloud").when(ref.isNotNull(), "reference")
        else:
            values[q] = F.greatest(own, ref)
            status[q] = F.when(own.isNull(), F.when(ref.isNotNull(), "reference")).when(own >= ref, "cloud").otherwise("floor")
    clipped = F.array_compact(F.array(*(F.when(values[q] < direct[q], F.lit(q)) for q in QUADRANTS)))
    radii = F.struct(*(F.greatest(values[q], direct[q]).alias(q) for q in QUADRANTS))
    known = values["rne"].isNotNull() & values["rse"].isNotNull() & values["rsw"].isNotNull() & values["rnw"].isNotNull()
    return F.when(known, F.struct(radii.alias("radii"), F.struct(*(status[q].alias(q) for q in QUADRANTS)).alias("status"), clipped.alias("clipped")))


def at_least(r: Column, floor: Column) -> Column:
    """By quadrant the larger radius."""
    return F.struct(*(F.greatest(r[q], floor[q]).alias(q) for q in QUADRANTS))


def largest(*radii: Column) -> Column:
    """The largest radius of all quadrants that is known."""
    return F.greatest(*(r[q] for r in radii for q in QUADRANTS))
