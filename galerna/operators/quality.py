"""Quality control: all checks of a snapshot as one row of counted violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HAZARDS = ("h_total", "h_p", "h_pdir", "h_pind", "h_w", "h_dir", "h_ind")
TOLERANCE = 1e-12


def out_of_bounds(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.count_if((x < low) | (x > high) | F.isnan(x))


def report(df: DataFrame, hazards: tuple[str, ...] = HAZARDS) -> DataFrame:
    """Violations of bounds of each hazard, of direct <= attribution, of zero outside, and of exclusive masks."""
    flags = sum((F.col(m).cast("int") for m in ("m_direct", "m_indirect", "m_exterior")), F.lit(0))
    return df.agg(
        F.count("*").alias("n"),
        *(out_of_bounds(F.col(h)).alias(f"bad_{h}") for h in hazards),
        F.count_if(F.col("r_direct") > F.col("r_attr")).alias("bad_radii"),
        F.count_if(F.col("m_exterior") & (F.abs("h_total") > TOLERANCE)).alias("bad_exterior"),
        F.count_if(flags != 1).alias("bad_masks"),
    )


def misaligned(reference: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two fields has, with the side."""
    a, b = reference.select(*keys), other.select(*keys)
    return a.exceptAll(b).withColumn("only_in", F.lit("reference")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("other")))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise KeyError(f"missing columns: {', '.join(absent)}")
    return df


def require_units(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """Units are metadata of the columns."""
    for name, unit in units.items():
        found = df.schema[name].metadata.get("units")
        if found != unit:
            raise ValueError(f"{name} is in {found}, not in {unit}")
    return df


def with_units(df: DataFrame, units: dict[str, str]) -> DataFrame:
    return reduce(lambda d, item: d.withMetadata(item[0], {"units": item[1]}), units.items(), df)


def failed(row: dict) -> list[str]:
    return [k for k, v in row.items() if k.startswith("bad_") and v]
