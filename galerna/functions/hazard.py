"""Rain hazard, regions, components and the bounded index."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from galerna.constants import EPSILON, RAIN_BASE, RAIN_ESCALATED, RAIN_ESCALATION, RAIN_NODES
from galerna.functions.basic import clip, lit


def rain_ramp(p: Column, quantiles: dict[str, Column], nodes: tuple[str, ...], values: tuple[float, ...], epsilon: float = EPSILON) -> Column:
    """Piecewise linear through (0, values[0]) and the nodes' quantiles; p < 0 gives values[0], NULL stays NULL.

    Quantiles closer than ``epsilon`` are pushed apart. Values must not decrease.
    """
    if len(values) != len(nodes) + 1 or any(a > b for a, b in zip(values, values[1:])):
        raise ValueError("a ramp needs one value more than nodes, none of them decreasing")
    x, y, out = F.lit(0.0), F.lit(float(values[0])), None
    steps, known = [], p.isNotNull()
    for name, value in zip(nodes, values[1:]):
        top = F.greatest(quantiles[name], x + epsilon)
        steps.append((x, y, top, F.lit(float(value))))
        known = known & quantiles[name].isNotNull()
        x, y = top, F.lit(float(value))
    out = y
    for x0, y0, x1, y1 in reversed(steps):
        out = F.when(p < x1, y0 + (y1 - y0) * (p - x0) / (x1 - x0)).otherwise(out)
    return F.when(known, F.when(p <= 0, F.lit(float(values[0]))).otherwise(out))


@dataclass(frozen=True)
class RainMatrix:
    """How rain of 6 h becomes a hazard, and which longer rains escalate it."""

    nodes: tuple[str, ...] = RAIN_NODES
    base: tuple[float, ...] = RAIN_BASE
    escalated: tuple[float, ...] = RAIN_ESCALATED
    escalation: dict = field(default_factory=lambda: dict(RAIN_ESCALATION))
    combine: str = "all"

    def hazard(self, p6: Column, q6: dict[str, Column], values: dict[str, Column], quantiles: dict[str, dict[str, Column]]) -> Column:
        """(1 - f) base + f escalated, f the product (all) or the maximum (any) of the escalating fractions."""
        if self.combine not in ("all", "any"):
            raise ValueError(f"unknown combine: {self.combine}")
        fractions = []
        for name, (low, high) in self.escalation.items():
            q0 = F.lit(0.0) if low is None else quantiles[name][low]
            f = clip((values[name] - q0) / F.greatest(quantiles[name][high] - q0, F.lit(EPSILON)))
            fractions.append(F.coalesce(f, F.lit(0.0)))
        f = fractions[0]
        for g in fractions[1:]:
            f = f * g if self.combine == "all" else F.greatest(f, g)
        base, escalated = (rain_ramp(p6, q6, self.nodes, v) for v in (self.base, self.escalated))
        return (1 - f) * base + f * escalated


def region(r: Column, direct: Column, attribution: Column) -> Column:
    """direct (r <= direct), indirect (up to attribution) or exterior; NULL if a radius is unknown."""
    return F.when(r <= direct, "direct").when(r <= attribution, "indirect").when(r > attribution, "exterior")


def masks(r: Column, direct: Column, attribution: Column) -> dict[str, Column]:
    """m_direct, m_indirect, m_exterior; unknown is false."""
    inside = F.coalesce(r <= direct, F.lit(False))
    return {
        "m_direct": inside,
        "m_indirect": F.coalesce((r > direct) & (r <= attribution), F.lit(False)),
        "m_exterior": F.coalesce(r > attribution, F.lit(False)) & ~inside,
    }


def masked(hazard: Column, mask: Column, fill: float = 0.0) -> Column:
    return F.when(mask, hazard).otherwise(F.lit(fill))


def combined(a: Column, b: Column, weight_a: float = 1.0, weight_b: float = 1.0) -> Column:
    """1 - (1 - a)^weight_a (1 - b)^weight_b, clipped to [0, 1]; NULL if either is."""
    if weight_a < 0 or weight_b < 0:
        raise ValueError("weights must not be negative")
    miss = lambda x, w: (1 - clip(x)) if w == 1 else F.pow(1 - clip(x), lit(float(w)))
    return clip(1 - miss(a, weight_a) * miss(b, weight_b))


def components(h_p: Column, h_w: Column, m: dict[str, Column], alpha: float = 1.0, beta: float = 1.0, lam: float = 1.0, mu: float = 1.0, indirect_wind: bool = True) -> dict[str, Column]:
    """h_pdir, h_pind, h_wdir, h_wind, h_dir, h_ind and h_total of a cell."""
    h_pdir, h_pind = masked(h_p, m["m_direct"]), masked(h_p, m["m_indirect"])
    h_wdir, h_wind = masked(h_w, m["m_direct"]), masked(h_w, m["m_indirect"])
    h_dir = combined(h_wdir, h_pdir, alpha, beta)
    h_ind = combined(h_wind, h_pind) if indirect_wind else clip(h_pind)
    return {
        "h_pdir": h_pdir, "h_pind": h_pind, "h_wdir": h_wdir, "h_wind": h_wind,
        "h_dir": h_dir, "h_ind": h_ind, "h_total": combined(h_dir, h_ind, lam, mu),
    }


def longest_of(levels: dict[str, Column]) -> tuple[Column, Column]:
    """(largest level, first series that has it); levels below 0 are missing."""
    known = {k: F.when(v >= 0, v) for k, v in levels.items()}
    top = F.greatest(*known.values())
    name = F.coalesce(*(F.when(v == top, F.lit(k)) for k, v in known.items()))
    return top, name


def escalated_level(level6: Column, base: tuple[int, ...], classes: tuple[int, ...], conditions: list[Column], level: int, mode: str = "all") -> tuple[Column, Column]:
    """(base level, base level raised to ``level`` for some 6-h classes where the conditions hold)."""
    ramp = F.when(level6 >= 0, F.element_at(F.array(*map(F.lit, base)), (level6 + 1).cast("int")))
    met = F.coalesce(conditions[0], F.lit(False))
    for c in conditions[1:]:
        c = F.coalesce(c, F.lit(False))
        met = met & c if mode == "all" else met | c
    raised = F.when(level6.isin(*classes) & met, F.greatest(ramp, F.lit(level))).otherwise(ramp)
    return ramp, F.when(level6 >= 0, raised)

