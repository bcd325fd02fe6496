"""Hours as bits: a repeated hour never stands for one that lacks, in batch and as a stream."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from galerna.operators import rain
from galerna.streaming import rain as stream_rain

T0 = dt.datetime(2024, 5, 1)
HOUR = dt.timedelta(hours=1)
CASES = {
    "whole": [(k, float(k)) for k in range(6)],
    "repeated": [(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0), (4, 5.0), (4, 50.0)],
    "twice but whole": [(k, 1.0) for k in range(6)] + [(2, 7.0), (5, 0.5)],
    "invalid first": [(0, -1.0), (0, 2.0)] + [(k, 1.0) for k in range(1, 6)],
    "invalid": [(k, 1.0) for k in range(5)] + [(5, math.nan)],
    "null": [(k, None) for k in range(6)],
}
WANT = {"whole": (15.0, 6), "repeated": (None, 5), "twice but whole": (5.5, 6), "invalid first": (7.0, 6), "invalid": (None, 5), "null": (None, 0)}


@pytest.fixture(scope="module")
def hourly(spark):
    rows = [(name, T0 + k * HOUR, p) for name, values in CASES.items() for k, p in values]
    return spark.createDataFrame(rows, "cell string, time timestamp, p double")


def test_batch(hourly):
    got = {r.cell: (r.p6, r.n) for r in rain.accumulate(hourly, ["cell"]).collect()}
    assert got == WANT
    at_end = hourly.withColumn("time", F.col("time") + F.expr("interval 1 hour"))
    assert {r.cell: (r.p6, r.n) for r in rain.accumulate(at_end, ["cell"], label_is="end").collect()} == WANT


def test_the_first_by_order_counts(spark):
    rows = [(1, T0 + k * HOUR, 1.0, k) for k in range(6)] + [(1, T0, 9.0, -5), (1, T0 + 3 * HOUR, 0.0, 99)]
    df = spark.createDataFrame(rows, "cell int, time timestamp, p double, place int")
    assert rain.accumulate(df, ["cell"], order="place").head().p6 == 14.0


def test_stream(spark, hourly, tmp_path):
    source = str(tmp_path / "in")
    late = spark.createDataFrame([("z", T0 + 48 * HOUR, 0.0)], "cell string, time timestamp, p double")
    hourly.union(late).withColumnRenamed("time", "ts").repartition(3).write.parquet(source)
    stream = spark.readStream.schema("cell string, ts timestamp, p double").parquet(source)
    query = stream_rain.accumulate(stream, "cell").writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {r.cell: (r.p6, r.n) for r in spark.table("hours").filter("cell <> 'z'").collect()} == WANT


def test_times_off_the_axis_are_an_error(spark):
    rows = [(1, T0), (1, T0 + 6 * HOUR), (1, T0 + 13 * HOUR), (2, T0 + 3 * HOUR), (2, T0 + 15 * HOUR)]
    df = spark.createDataFrame([(c, t, 1.0) for c, t in rows], "cell int, time timestamp, p6 double")
    assert [r.p6 for r in rain.gap_filled(df.filter("cell = 2"), ["cell"]).orderBy("time").collect()] == [1.0, None, 1.0]
    with pytest.raises(Exception, match="off its axis: 2024-05-01 13:00"):
        rain.gap_filled(df, ["cell"]).collect()
    with pytest.raises(Exception, match="off its axis"):
        rain.gap_filled(df.filter("cell = 2").union(df.filter("cell = 2")), ["cell"]).collect()
