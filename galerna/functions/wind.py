"""Parametric wind profile: dual exponential decay with a polynomial transition, and radii by bisection.

Roots are found by folds over a sequence (``aggregate``), on storm rows only; evaluation at a cell is a plain
expression. A profile is a struct (vmax, rmax, n, a, x1, r1, width), made once for each storm position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galerna.constants import EPSILON, KNOT_MS, OUTER_MS, R34_MS, TROPICAL_STORM_KT, WIND_NODES
from galerna.functions.basic import clip, lit, once, piecewise, positive

X2_KM = 25.0
SEARCH_KM = 5000.0
#: Coefficient, decay with wind and growth with latitude of the radius of maximum wind.
RMAX = {"w06": (46.4, -0.0155, 0.0169), "pa21": (46.6, -0.015, 0.0169)}


def bisect(f, low, high, steps: int) -> Column:
    """Root of a decreasing function of a column, by halvings."""

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        return once(
            F.struct(middle.alias("m"), (f(middle) > 0).alias("up"), s.alias("s")),
            lambda t: F.struct(
                F.when(t["up"], t["m"]).otherwise(t["s"]["low"]).alias("low"),
                F.when(t["up"], t["s"]["high"]).otherwise(t["m"]).alias("high"),
            ),
        )

    start = F.struct(lit(low).cast("double").alias("low"), lit(high).cast("double").alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["low"] + s["high"]) / 2)


def rmax_km(vmax_ms: Column, lat: Column, variant: str = "w06") -> Column:
    if variant not in RMAX:
        raise ValueError(f"unknown variant: {variant}")
    a, b, c = RMAX[variant]
    return a * F.exp(b * vmax_ms + c * F.abs(lat))


def ramp(xi: Column) -> Column:
    """0 to 1 over xi in [0, 1], with four flat derivatives at both ends."""
    x = F.least(F.greatest(xi, F.lit(0.0)), F.lit(1.0))
    return once(x, lambda v: F.pow(v, 5.0) * (126 + v * (-420 + v * (540 + v * (-315 + 70 * v)))))


def profile(vmax_ms: Column, lat: Column, rmw_km=None, x1_km=None, variant: str = "w06", w_condition: str = "exact") -> Column:
    """Parameters of the profile as a struct. Missing or non-positive rmw and missing x1 take their regressions."""
    if w_condition not in ("exact", "linear"):
        raise ValueError(f"unknown w_condition: {w_condition}")
    rmax = rmax_km(vmax_ms, lat, variant)
    if rmw_km is not None:
        rmax = F.coalesce(positive(lit(rmw_km)), rmax)
    # Published regressions of x1, n and a on wind and latitude.
    x1 = 317.1 - 2.026 * vmax_ms + 1.915 * F.abs(lat)
    if x1_km is not None:
        x1 = F.coalesce(lit(x1_km), x1)
    shape = F.struct(
        vmax_ms.alias("vmax"), rmax.alias("rmax"), x1.alias("x1"),
        (0.4067 + 0.0144 * vmax_ms - 0.0038 * F.abs(lat)).alias("n"),
        F.greatest(0.0696 + 0.0049 * vmax_ms - 0.0064 * F.abs(lat), F.lit(0.0)).alias("a"),
    )

    def weight_at_rmax(s: Column) -> Column:
        if w_condition == "linear":
            x = (1 - s["a"]) * s["x1"] + s["a"] * X2_KM
            return s["n"] * x / (s["n"] * x + s["rmax"])
        return s["n"] / (s["n"] + s["rmax"] * ((1 - s["a"]) / s["x1"] + s["a"] / X2_KM))

    def whole(s: Column) -> Column:
        width = F.when(s["rmax"] > 20, 25.0).otherwise(15.0)
        xi = once(weight_at_rmax(s), lambda w: bisect(lambda x: w - ramp(x), 0.0, 1.0, 50))
        return F.struct(
            *(s[k].alias(k) for k in ("vmax", "rmax", "n", "a", "x1")),
            F.greatest(s["rmax"] - xi * width, F.lit(0.0)).alias("r1"), width.alias("width"),
        )

    return F.when(vmax_ms.isNotNull() & lat.isNotNull(), once(shape, whole))


def wind_ms(p: Column, r) -> Column:
    """Wind of a profile at a radius (km)."""
    r = lit(r)
    inner = p["vmax"] * F.pow(r / p["rmax"], p["n"])
    d = r - p["rmax"]
    outer = p["vmax"] * ((1 - p["a"]) * F.exp(-d / p["x1"]) + p["a"] * F.exp(-d / X2_KM))
    w = ramp((r - p["r1"]) / p["width"])
    return once(w, lambda v: inner * (1 - v) + outer * v)


def radius_of_wind(p: Column, threshold_ms, limit_km: float = SEARCH_KM, steps: int = 60) -> Column:
    """Outer radius where the wind is the threshold; NULL where vmax is not above it, or the limit is not below it."""
    t = lit(threshold_ms)

    def of(q: Column) -> Column:
        found = bisect(lambda r: wind_ms(q, r) - t, q["rmax"], limit_km, steps)
        return F.when((q["vmax"] > t) & (wind_ms(q, limit_km) <= t), found)

    return once(p, of)


def fitted_x1(vmax_ms: Column, lat: Column, rmax: Column, radius_km: Column, wind=R34_MS, low=10.0, high=2000.0, steps: int = 50, variant="w06") -> Column:
    """x1 for which the wind at ``radius_km`` is ``wind``; NULL where none in the bounds is."""

    def residual(x1: Column) -> Column:  # wind grows with x1, so its negative decreases
        return once(profile(vmax_ms, lat, rmax, x1, variant), lambda p: wind - wind_ms(p, radius_km))

    known = radius_km.isNotNull() & (radius_km > rmax) & (vmax_ms > wind)
    feasible = (residual(F.lit(low)) >= 0) & (residual(F.lit(high)) <= 0)
    return F.when(known & feasible, bisect(residual, low, high, steps))


def reference_radii(vmax_kt: Column, lat: Column, rmw_km=None, r34_mean_km=None, variant: str = "pa21", outer_ms: float = OUTER_MS) -> Column:
    """(r_outer_km, r34_km, rmax_km, x1_km) of a storm position; rmw and r34 are used only if given."""
    v = vmax_kt * KNOT_MS
    x1 = None
    if r34_mean_km is not None:
        rmax = F.coalesce(positive(lit(rmw_km)), rmax_km(v, lat, variant)) if rmw_km is not None else rmax_km(v, lat, variant)
        x1 = fitted_x1(v, lat, rmax, lit(r34_mean_km), variant=variant)
    return once(
        profile(v, lat, rmw_km, x1, variant),
        lambda p: F.struct(
            radius_of_wind(p, outer_ms).alias("r_outer_km"), radius_of_wind(p, R34_MS).alias("r34_km"),
            p["rmax"].alias("rmax_km"), p["x1"].alias("x1_km"),
        ),
    )


def parametric_radii(vmax_kt: Column, lat: Column, thresholds_ms: dict[str, float], rmw_km=None, r34_mean_km=None, variant: str = "w06") -> Column:
    """A struct: outer radius of each threshold by name, rmax_km, x1_km, n, a, and whether x1 is fitted to the 34-kt radius."""
    v = vmax_kt * KNOT_MS
    rmax = rmax_km(v, lat, variant) if rmw_km is None else F.coalesce(positive(lit(rmw_km)), rmax_km(v, lat, variant))
    fit = F.lit(None).cast("double") if r34_mean_km is None else fitted_x1(v, lat, rmax, lit(r34_mean_km), variant=variant)

    def of(t: Column) -> Column:
        return once(profile(v, lat, t["rmax"], t["x1"], variant), lambda p: F.struct(
            *(radius_of_wind(p, x).alias(name) for name, x in thresholds_ms.items()), p["rmax"].alias("rmax_km"), p["x1"].alias("x1_km"),
            p["n"].alias("n"), p["a"].alias("a"), t["x1"].isNotNull().alias("x1_calibrated"),
        ))

    return once(F.struct(rmax.alias("rmax"), fit.alias("x1")), of)


def wind_hazard(wind_kt: Column, outer_kt: Column, nodes=WIND_NODES) -> Column:
    """Hazard of a wind: linear between the nodes, and below the first a tail down to zero at ``outer_kt``."""
    first_kt, first_h = nodes[0]
    tail = first_h * clip((wind_kt - outer_kt) / F.greatest(first_kt - outer_kt, F.lit(EPSILON)))
    return F.when(wind_kt < first_kt, tail).otherwise(piecewise(wind_kt, list(nodes)))


def hazard_with_tail(r: Column, direct_km: Column, outer_km: Column, storm: Column, tail_end_kt: float = 12.0 / KNOT_MS, nodes=WIND_NODES) -> Column:
    """(h_w, wind_kt, outer_kt) at a distance, for storm (profile, vmax_kt, r34_mean_km if calibrated, else NULL).

    With a calibrated profile distances are scaled so that 34 kt fall on the quadrant's direct radius. Within the
    radius of maximum wind the hazard is that of vmax.
    """
    scale = F.coalesce(positive(storm["r34_mean_km"] / F.nullif(direct_km, F.lit(0.0))), F.lit(1.0))

    def at(s: Column) -> Column:
        p = storm["profile"]
        v = wind_ms(p, r * s) / KNOT_MS
        outer = F.greatest(wind_ms(p, outer_km * s) / KNOT_MS, F.lit(float(tail_end_kt)))
        felt = F.when(r * s <= p["rmax"], storm["vmax_kt"])
        return once(
            F.struct(v.alias("v"), outer.alias("o"), felt.alias("f")),
            lambda t: F.struct(wind_hazard(F.coalesce(t["f"], t["v"]), t["o"], nodes).alias("h_w"), t["v"].alias("wind_kt"), t["o"].alias("outer_kt")),
        )

    return once(scale, at)


def calibrated_storm(vmax_kt: Column, lat: Column, rmw_km: Column, r34_mean_km: Column, variant: str = "w06") -> Column:
    """The struct that ``hazard_with_tail`` takes: x1 is fitted to the mean 34-kt radius where that can be done."""
    v = vmax_kt * KNOT_MS
    rmax = F.coalesce(positive(rmw_km), rmax_km(v, lat, variant))
    fit = F.when(vmax_kt > TROPICAL_STORM_KT, fitted_x1(v, lat, rmax, r34_mean_km, variant=variant))
    return once(
        F.struct(fit.alias("x1"), r34_mean_km.alias("r34")),
        lambda t: F.struct(
            profile(v, lat, rmw_km, t["x1"], variant).alias("profile"), vmax_kt.alias("vmax_kt"),
            F.when(t["x1"].isNotNull(), t["r34"]).alias("r34_mean_km"),
        ),
    )
