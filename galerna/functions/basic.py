"""Null-safe arithmetic and class functions. Missing values are NULL everywhere; NaN is turned into NULL on reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galerna.constants import CLASS_BOUNDS, CLASS_LABELS


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def positive(x: Column) -> Column:
    """x where it is greater than zero, else NULL."""
    return F.when(x > 0, x)


def non_negative(x: Column) -> Column:
    return F.when(x >= 0, x)


def greatest_strict(*columns: Column) -> Column:
    """Greatest value, NULL if any is NULL (``greatest`` skips NULLs)."""
    known = columns[0].isNotNull()
    for c in columns[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.greatest(*columns))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def once(value: Column, make) -> Column:
    """``make(value)`` with ``value`` evaluated once: a lambda's variable stands for it."""
    return F.transform(F.array(value), make)[0]


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections use by value.

    A filter on a plain column is pushed below its projection with the whole expression in its place, once for each
    use; chains of long expressions would grow without bound. Rows go through a generator of one row instead, below
    which nothing that uses its output can be pushed.
    """
    row = F.struct(*(c.alias(k) for k, c in columns.items()))
    return df.select("*", F.inline(F.array(row)))


def piecewise(x: Column, nodes: list[tuple[Column | float, Column | float]]) -> Column:
    """Linear through the nodes (ascending), constant outside; NULL where x is."""
    nodes = [(lit(a), lit(b)) for a, b in nodes]
    out = nodes[-1][1]
    for (x0, y0), (x1, y1) in reversed(list(zip(nodes, nodes[1:]))):
        out = F.when(x < x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(out)
    return F.when(x.isNotNull(), F.when(x <= nodes[0][0], nodes[0][1]).otherwise(out))


def hazard_class(x: Column) -> Column:
    """0 for x <= 0, else 1..5 by steps (lower, upper] of 0.2; NULL stays NULL."""
    out = F.lit(len(CLASS_BOUNDS) - 1)
    for k in range(len(CLASS_BOUNDS) - 2, -1, -1):
        out = F.when(x <= CLASS_BOUNDS[k], F.lit(k)).otherwise(out)
    return F.when(x.isNotNull(), out)


def hazard_class_filled(x: Column) -> Column:
    return hazard_class(F.coalesce(x, F.lit(0.0)))


def class_label(x: Column) -> Column:
    """The name of the hazard class of x."""
    return F.element_at(F.array(*map(F.lit, CLASS_LABELS)), hazard_class(x) + 1)


def percentile_level(x: Column, quantiles: list[tuple[int, Column]]) -> Column:
    """The highest percentile (75, 90, ...) that x reaches, 0 if none."""
    return F.greatest(F.lit(0), *(F.when(x >= q, F.lit(p)).otherwise(F.lit(0)) for p, q in quantiles))


def level_index(x: Column, quantiles: list[Column]) -> Column:
    """How many of the ascending percentiles x reaches; -1 without data."""
    n = sum((F.when(x >= q, 1).otherwise(0) for q in quantiles), F.lit(0))
    known = x.isNotNull()
    for q in quantiles:
        known = known & q.isNotNull()
    return F.when(known, n).otherwise(F.lit(-1))


def percentile_labels(quantiles: tuple[float, ...]) -> list[str]:
    """P75, P90, ..., P99_9."""
    return [f"P{100 * q:g}".replace(".", "_") for q in quantiles]


def quantile_name(q: float) -> str:
    """Q75, Q90, ..., Q99.9."""
    return f"Q{100 * q:g}"


def level_names(labels: list[str]) -> list[str]:
    """<P75, P75-P90, ..., >=P99_9."""
    return [f"<{labels[0]}", *(f"{a}-{b}" for a, b in zip(labels, labels[1:])), f">={labels[-1]}"]


def level_label(level: Column, labels: list[str]) -> Column:
    names = F.array(*map(F.lit, level_names(labels)))
    return F.when(level >= 0, F.element_at(names, (level + 1).cast("int")))
