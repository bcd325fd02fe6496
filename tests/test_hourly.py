"""Indices of hourly files and resumable seasons."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from galerna import jobs
from galerna.config import RainOptions
from galerna.operators import joins
from galerna.sources import hourly, tables


def put(spark, folder, time, rows, name=None):
    """One hourly file as a plain Parquet file."""
    os.makedirs(folder, exist_ok=True)
    df = spark.createDataFrame([(time, a, b, v) for a, b, v in rows], "time timestamp, lat double, lon double, precipitation double")
    df.toPandas().astype({"time": "datetime64[us]"}).to_parquet(f"{folder}/{name or f'{time:%Y%j}.{time:%H}'}.parquet", index=False)


@pytest.fixture
def folder(spark, tmp_path):
    at = str(tmp_path / "in")
    for year in (2023, 2024):
        for h in range(12):
            if (year, h) != (2024, 8):
                put(spark, at, dt.datetime(year, 6, 1, h), [(10.0, -100.0, 1.0 * h), (10.0, -99.0, 2.0)])
    return at


def test_names_are_believed_or_files_opened(spark, folder):
    found, fast = hourly.index(spark, folder)
    assert fast and found.count() == 23
    assert [r.time.hour for r in hourly.missing_hours(found.filter("year(time) = 2024")).collect()] == [8]
    # a repeated time: its first file counts
    put(spark, folder, dt.datetime(2024, 6, 1, 3), [(10.0, -100.0, 99.0)], "again_2024060103")
    found, fast = hourly.index(spark, folder)
    assert fast and found.count() == 23
    assert found.filter("year(time) = 2024 and hour(time) = 3").head().path.endswith("/2024153.03.parquet")
    # a name that tells another time than the file holds: all files are opened
    put(spark, folder, dt.datetime(2024, 6, 1, 8), [(10.0, -100.0, 8.0)], "2024153.20")
    found, fast = hourly.index(spark, folder)
    assert not fast and {r.time.hour for r in found.filter("year(time) = 2024").collect()} == set(range(12))
    put(spark, folder, dt.datetime(2024, 6, 1, 9), [(10.0, -100.0, 8.0)], "nameless")
    assert not hourly.index(spark, folder)[1]
    with pytest.raises(FileNotFoundError):
        hourly.index(spark, folder, "*.nc")


def test_a_second_run_reads_nothing_and_a_changed_file_redoes_its_season(spark, folder, tmp_path, monkeypatch):
    out, opened = str(tmp_path / "out"), []
    real = hourly.parquet_files
    reader = lambda s, paths: opened.append(paths) or real(s, paths)
    run = lambda **more: hourly.resume(spark, folder, out, lambda rows: jobs.accumulate(rows, RainOptions(2020, 2025)), 2020, 2025, read=reader, **more)
    assert run() == [2023, 2024]
    sums = {(r.season, r.lon, r.time.hour): (r.p6, r.n) for r in spark.read.parquet(f"{out}/series").collect()}
    assert sums[2023, -100.0, 6] == (15.0, 6) and sums[2023, -100.0, 12] == (51.0, 6) and sums[2024, -100.0, 12] == (None, 5) and sums[2024, -99.0, 6] == (12.0, 6)
    opened.clear()
    assert run() == [] and len(opened) == 1 and len(opened[0]) <= hourly.VALIDATED  # the names are validated, no season is read
    put(spark, folder, dt.datetime(2024, 6, 1, 8), [(10.0, -100.0, 8.0), (10.0, -99.0, 2.0)])
    opened.clear()
    assert run() == [2024] and all("/2023" not in p for p in opened[1])
    again = {(r.season, r.lon, r.time.hour): r.p6 for r in spark.read.parquet(f"{out}/series").collect()}
    assert again[2024, -100.0, 12] == 51.0 and again[2023, -100.0, 12] == 51.0
    assert run(overwrite=True) == [2023, 2024]
    assert {r.season: r.files for r in hourly.ledger(spark, out).collect()} == {2023: 12, 2024: 12}
    jobs.main(["hours", "--table", f"files={folder}", "--out", str(tmp_path / "job")])
    assert spark.read.parquet(f"{tmp_path}/job/series").count() == 8


def test_units_and_labels(spark):
    T0 = dt.datetime(2024, 6, 1)
    rows = [(1, T0 + dt.timedelta(hours=k + 1), 0.001, T0 + dt.timedelta(hours=k), T0 + dt.timedelta(hours=k + 1)) for k in range(6)]
    df = spark.createDataFrame(rows, "cell int, valid_time timestamp, precipitation double, low timestamp, high timestamp")
    # the bounds tell that labels are ends, and the unit that values are metres
    assert [(r.time, round(r.p6, 9)) for r in jobs.accumulate(df, RainOptions(2020, 2025, unit="m")).collect()] == [(T0 + dt.timedelta(hours=6), 6.0)]
    assert jobs.accumulate(df.drop("low"), RainOptions(2020, 2025)).count() == 2
    with pytest.raises(ValueError, match="either end"):
        jobs.label_of(df.union(df.withColumn("valid_time", F.col("low"))), RainOptions())
    assert tables.rain_factor(" KG m-2 s-1 ") == 3600.0 and tables.rain_factor("") == 1.0
    with pytest.raises(ValueError, match="unknown unit"):
        tables.rain_factor("inches")


def test_targets_that_are_not_synoptic_are_an_error(spark):
    t = spark.createDataFrame([(1, 1, dt.datetime(2024, 6, 1, 6)), (2, 1, dt.datetime(2024, 6, 1, 7))], "target_id int, cell int, target_time timestamp")
    s = t.select("cell", F.col("target_time").alias("time"), F.lit(1.0).alias("p6"))
    assert joins.exact_in_time(t, s, ["cell"]).count() == 2
    assert joins.exact_in_time(t.filter("target_id = 1"), s, ["cell"], synoptic_only=True).count() == 1
    with pytest.raises(Exception, match="not a synoptic time: 2024-06-01 07"):
        joins.exact_in_time(t, s, ["cell"], synoptic_only=True).collect()
