"""Extreme-value distributions by L-moments, as expressions over the moments' columns.

Shapes carry the sign of xi (heavy tails positive). Moments and parameters are columns; results are structs or columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from galerna.constants import GEV_MIN_SEASONS, GPD_MIN_EXCESSES, SHAPE_BOUNDS
from galerna.functions.basic import lit, once

TINY = 1e-6
#: Lanczos coefficients for g = 7.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def gamma(x: Column) -> Column:
    """Gamma function for x >= 0.5."""

    def of(z: Column) -> Column:
        total = F.lit(LANCZOS[0])
        for k, c in enumerate(LANCZOS[1:], 1):
            total = total + c / (z + float(k))
        t = z + LANCZOS_G + 0.5
        return math.sqrt(2 * math.pi) * F.pow(t, z + 0.5) * F.exp(-t) * total

    return once(x - 1.0, of)


def clipped_shape(k: Column, bounds: tuple[float, float] = SHAPE_BOUNDS) -> Column:
    """k = -xi held so that xi is within the bounds."""
    return F.least(F.greatest(k, F.lit(-bounds[1])), F.lit(-bounds[0]))


def gev(l1: Column, l2: Column, l3: Column, n: Column, min_n: int = GEV_MIN_SEASONS, bounds=SHAPE_BOUNDS) -> Column:
    """(xi, sigma, mu, clipped) of a GEV; NULL with fewer than ``min_n`` values or where the scale is not positive."""
    c = 2.0 / (3.0 + l3 / F.nullif(l2, F.lit(0.0))) - math.log(2) / math.log(3)
    raw = 7.8590 * c + 2.9554 * c * c

    def fit(k: Column) -> Column:
        small = F.abs(k) < TINY
        safe = F.when(small, 1.0).otherwise(k)
        g = gamma(1.0 + safe)
        alpha = F.when(small, l2 / math.log(2)).otherwise(l2 * safe / ((1 - F.pow(F.lit(2.0), -safe)) * g))
        euler = 0.5772156649015329
        mu = F.when(small, l1 - euler * alpha).otherwise(l1 - alpha * (1 - g) / safe)
        return F.struct((-k).alias("xi"), alpha.alias("sigma"), mu.alias("mu"))

    fitted = once(clipped_shape(raw, bounds), fit)
    whole = once(fitted, lambda f: F.when(f["sigma"] > 0, F.struct(
        f["xi"].alias("xi"), f["sigma"].alias("sigma"), f["mu"].alias("mu"), (clipped_shape(raw, bounds) != raw).alias("clipped")
    )))
    return F.when((n >= min_n) & (l2 != 0), whole)


def gev_level(t, xi: Column, sigma: Column, mu: Column) -> Column:
    """Level of return period ``t`` years (> 1)."""
    if not isinstance(t, Column) and t <= 1:
        raise ValueError("a return period must be above 1 year")
    y = -F.log1p(-1.0 / lit(t))
    curved = F.abs(xi) >= TINY
    return F.when(curved, mu + sigma / F.when(curved, xi) * (F.pow(y, -xi) - 1)).otherwise(mu - sigma * F.log(y))


def gev_period(x: Column, xi: Column, sigma: Column, mu: Column) -> Column:
    """Return period of a level: infinite beyond an upper bound, 1 below a lower bound."""
    z = (x - mu) / sigma
    curved = F.abs(xi) >= TINY
    inside = 1 + xi * z
    t = F.when(curved, F.pow(F.when(inside > 0, inside), -1.0 / F.when(curved, xi))).otherwise(F.exp(-z))
    years = F.when(t > 0, 1.0 / -F.expm1(-t)).otherwise(F.lit(float("inf")))
    outside = F.when(xi < 0, F.lit(float("inf"))).otherwise(F.lit(1.0))
    known = x.isNotNull() & xi.isNotNull()
    return F.when(known, F.when(curved & (inside <= 0), outside).otherwise(years))


def gpd(l1: Column, l2: Column, n_excess: Column, n_seasons: Column, min_excess: int = GPD_MIN_EXCESSES, bounds=SHAPE_BOUNDS) -> Column:
    """(xi, sigma, rate, clipped) of a GPD from the L-moments of the excesses."""
    raw = l1 / F.nullif(l2, F.lit(0.0)) - 2.0

    def fit(k: Column) -> Column:
        return F.struct((-k).alias("xi"), ((1 + k) * l1).alias("sigma"), (n_excess / n_seasons).alias("rate"), (k != raw).alias("clipped"))

    fitted = once(clipped_shape(raw, bounds), fit)
    return F.when((n_excess >= min_excess) & (l2 != 0), once(fitted, lambda f: F.when(f["sigma"] > 0, f)))


def pot_level(r, u: Column, sigma: Column, xi: Column, rate: Column) -> Column:
    """Level exceeded once in ``r`` seasons on average; NULL where the rate does not reach so far down."""
    ratio = rate * lit(r)
    curved = F.abs(xi) >= TINY
    level = F.when(curved, u + sigma / F.when(curved, xi) * (F.pow(ratio, xi) - 1)).otherwise(u + sigma * F.log(ratio))
    return F.when(ratio >= 1, level)


def pot_interval(x: Column, u: Column, sigma: Column, xi: Column, rate: Column) -> Column:
    """Mean interval (seasons) between exceedances of x; NULL below u, infinite past the upper bound."""
    z = (x - u) / sigma
    curved = F.abs(xi) >= TINY
    inside = 1 + xi * z
    tail = F.when(curved, F.pow(F.when(inside > 0, inside), 1.0 / F.when(curved, xi))).otherwise(F.exp(z))
    return F.when(x >= u, F.when(curved & (inside <= 0), F.lit(float("inf"))).otherwise(tail / rate))


def annual_period(r: Column) -> Column:
    """T = 1 / (1 - exp(-1 / R))."""
    return -1.0 / F.expm1(-1.0 / r)


def recurrence(t: Column) -> Column:
    """R = -1 / ln(1 - 1 / T)."""
    return -1.0 / F.log1p(-1.0 / t)


def events_a_season(q: float, wet_frequency: Column, windows: Column, duration_h: int = 6) -> Column:
    """Independent windows a season above the wet-window percentile q."""
    return (1 - q) * wet_frequency * windows / (duration_h / 6)


def gringorten(rank: Column, n: Column) -> Column:
    """Plotting-position return period of the rank-th largest of n values."""
    return (n + 0.12) / (rank - 0.44)
