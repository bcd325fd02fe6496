"""Jobs to be started by spark-submit: hours, rain, percentiles, returns, case, declared. Each reads and writes Parquet tables.

``python -m galerna.jobs percentiles --table series=PATH --out PATH``

Tables: hours needs files, a folder of hourly rain files, and does the seasons whose files are new or changed; rain needs hourly (cell,
valid_time, precipitation), or with the bounds of its hours (low, high); percentiles and returns need series; case needs tracks, series,
grid, climatology and bridge; declared needs declared, tracks, places, bridge, series and percentiles_6, _24 and _72.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galerna.config import CaseOptions, PercentileOptions, RainOptions, ReturnOptions, load, options_of
from galerna.operators import quantiles, rain
from galerna.plans import case as case_plan
from galerna.plans import climatology
from galerna.plans import declared as declared_plan
from galerna.sources import hourly, tables
from galerna.sources.staging import Staging, unstaged


def accumulate(rows: DataFrame, options: RainOptions = RainOptions()) -> DataFrame:
    """6-h sums of the seasons' window ends: (cell, season, time, p6, n)."""
    keys = [c for c in ("cell", "lat", "lon") if c in rows.columns]
    rows = rows.withColumn("precipitation", F.col("precipitation") * tables.rain_factor(options.unit))
    sums = rain.accumulate(rows, keys, value="precipitation", time="valid_time", hours=options.hours, label_is=label_of(rows, options))
    return sums.withColumn("season", F.year(F.col("time") - F.expr("interval 1 hour"))).filter(F.col("season").between(options.first_year, options.last_year))


def label_of(rows: DataFrame, options: RainOptions) -> str:
    """Which end of its hour a label is: by the hours' bounds (low, high) where the table has them, which must agree."""
    if not {"low", "high"} <= {*rows.columns}:
        return options.label_is
    found = [r[0] for r in rows.select(tables.label_convention(F.col("valid_time"), F.col("low"), F.col("high"))).distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError("labels lie on either end of their hours")
    return found[0] if found else options.label_is


def hours(spark: SparkSession, folder: str, out: str, options: RainOptions = RainOptions()) -> list[int]:
    """Sums of a folder of hourly files, for the seasons that are not finished; which these were."""
    return hourly.resume(spark, folder, out, lambda rows: accumulate(rows, options), options.first_year, options.last_year, overwrite=options.overwrite)


def incomplete(sums: DataFrame, options: RainOptions = RainOptions()) -> DataFrame:
    """Window ends that lack hours, with how many cells they lack in: the report on bad or absent input."""
    return sums.filter(F.col("n") < options.hours).groupBy("season", "time").agg(F.count("*").alias("cells"), F.min("n").alias("least_hours"))


def percentiles(series: DataFrame, options: PercentileOptions = PercentileOptions()) -> dict[str, DataFrame]:
    own = series.filter(F.col("season").between(options.first_year, options.last_year))
    out = {"all": climatology.wet_percentiles(own, options.durations, options.levels)}
    return out | ({"by_hour": quantiles.wet_by_hour(own, ["cell"], "p6", levels=options.levels)} if options.by_hour else {})


def returns(
    series: DataFrame, options: ReturnOptions = ReturnOptions(), staged: Callable[[str, DataFrame], DataFrame] = unstaged
) -> dict[str, DataFrame]:
    own = series.filter(F.col("season").between(options.first_year, options.last_year))
    return climatology.return_periods(own, options.k, options.durations, options.min_seasons, options.min_excesses, staged)


def computed_once(spark: SparkSession, path: str, compute: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``, computed and written if it is not there yet (or ``force``)."""
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    tables.write(compute(), path)
    return spark.read.parquet(path)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="galerna.jobs")
    parser.add_argument("job", choices=("hours", "rain", "percentiles", "returns", "case", "declared"))
    parser.add_argument("--table", action="append", required=True, metavar="NAME=PATH")
    parser.add_argument("--out", required=True)
    parser.add_argument("--config", help="YAML with a section named like the job")
    given = parser.parse_args(arguments)
    paths = dict(t.split("=", 1) for t in given.table)
    for path in paths.values():
        tables.check_apart(path, given.out)
    spark = SparkSession.builder.appName(f"galerna-{given.job}").getOrCreate()
    config = load(given.config) if given.config else {}
    section = config.get(given.job) or {}
    if given.job == "hours":
        print("seasons done:", *hours(spark, paths["files"], given.out, options_of(RainOptions, section)))
        return
    read = {name: spark.read.parquet(path) for name, path in paths.items()}
    with Staging(spark) as staging:
        if given.job == "rain":
            options = options_of(RainOptions, section)
            sums = accumulate(read["hourly"], options)
            tables.write_seasons(sums, f"{given.out.rstrip('/')}/series")
            made = {"incomplete": incomplete(sums, options)}
        elif given.job == "percentiles":
            made = {n: climatology.with_product_units(t) for n, t in percentiles(read["series"], options_of(PercentileOptions, section)).items()}
        elif given.job == "returns":
            made = {n: climatology.with_product_units(t) for n, t in returns(read["series"], options_of(ReturnOptions, section), staging).items()}
        elif given.job == "case":
            options = options_of(CaseOptions, section)
            own = read["tracks"].filter(F.col("storm_id") == options.storm_id)
            settings = options.settings({k: v for k, v in config.items() if k in ("rain", "radii", "wind", "weights")})
            made = case_plan.run(own, read["series"], read["grid"], read["climatology"], read["bridge"], settings, options.lead_in_hours, staging)
        else:
            levels = {h: read[f"percentiles_{h}"] for h in (6, 24, 72)}
            plain = (read[n] for n in ("declared", "tracks", "places", "bridge", "series"))
            made = declared_plan.run(*plain, levels, options_of(declared_plan.Options, section), staging)
        declared_plan.write_tables(made, given.out, staging)


if __name__ == "__main__":
    main()
