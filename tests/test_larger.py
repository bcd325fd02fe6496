"""What larger tables brought to light: statistics that declarations share, ties, longitudes beyond 180, repeated names."""

import datetime as dt
import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_catalog import SF, rows_of

from galerna.operators import declarations as D
from galerna.operators import joins, quantiles
from galerna.plans import catalog, standins
from galerna.sources import staging, tables

T0 = dt.datetime(2024, 1, 1)


def test_ranges_of_dates_stand_for_their_declarations(spark):
    day = dt.timedelta(days=1)
    rows = [(k, k % 2, "DE"[k % 3 == 0], T0 + (k % 3) * day, T0 + (k % 3 + k % 2) * day) for k in range(40)]
    declared = spark.createDataFrame(rows, "id_decl long, place long, kind string, start timestamp, end timestamp")
    bridge = spark.createDataFrame([(c % 2, c) for c in range(5)], "place long, cell long")
    rain = spark.createDataFrame(
        [(c, T0 + s * day / 4, float((c * 7 + s * 5) % 11), 1.0, 2.0) for c in range(4) for s in range(20)], "cell long, time timestamp, p6 double, r24 double, a72 double"
    )
    each = D.cell_declarations_of(declared, bridge, rain, ["r24"])
    ranges = D.range_maxima(declared, bridge, rain, ["r24"]).join(D.range_members(declared), D.RANGE)
    assert ranges.count() < each.count()
    want = D.grouped_stats(each, ["cell"], "kind", "p6_max", "id_decl").collect()
    got = D.grouped_stats(ranges, ["cell"], "kind", "p6_max", "id_decl", "members").collect()
    plain = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    assert plain(got) == plain(want) and len(got) == 12


def against_sql(spark, folder, name):
    """Rows of a query and of its SQL over the tables of a folder."""
    c = duckdb.connect()
    for path in folder.glob("*.parquet"):
        c.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, want = catalog.queries()[name](spark, str(folder)), c.sql(catalog.oracle_sql()[name])
    return rows_of(got.columns, map(tuple, got.collect())), rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["gev_fit", "gev_levels", "gev_period"])
def test_suppliers_with_few_seasons_have_no_fit(spark, tmp_path, name):
    """Supplier 2 has 14 quarters."""
    duckdb.sql(f"""COPY (SELECT s::BIGINT AS l_suppkey, (s * 1000 + q)::BIGINT AS l_orderkey, k::INT AS l_linenumber, 1000.0 + (q * 7919 * k + 31 * s) % 9000 AS l_extendedprice,
      TIMESTAMP '1995-01-02' + to_months(3 * q::INT) AS l_shipdate FROM (SELECT unnest([1, 2]) AS s), range(0, 20) t(q), range(1, 5) u(k) WHERE s = 1 OR q < 14) TO '{tmp_path}/lineitem.parquet'""")  # fmt: skip
    got, want = against_sql(spark, tmp_path, name)
    assert got == want and len(got) == {"gev_fit": 1, "gev_levels": 6, "gev_period": 3}[name]


@pytest.mark.parametrize("name", ["on_grid", "snapshot_full", "storm_cells", "polygon_cells"])
def test_longitudes_beyond_180_count_as_they_are(spark, tmp_path, name):
    """Cells 600 to 644 lie 360 degrees east of the first ones."""
    duckdb.sql(f"""COPY (SELECT (c * 8)::BIGINT AS user_id, (c * 100 + s)::BIGINT AS event_id, TIMESTAMP '2024-01-01 01:00:00' + to_hours(6 * s::INT) AS ts, (1 + (c * 7 + s * 5) % 90)::DOUBLE AS value
      FROM (SELECT unnest(range(0, 45)) AS c UNION ALL SELECT unnest(range(600, 645))), range(0, 20) t(s)) TO '{tmp_path}/events.parquet'""")  # fmt: skip
    for table in ("nation", "orders"):
        duckdb.sql(f"COPY (SELECT * FROM '{SF}/{table}.parquet') TO '{tmp_path}/{table}.parquet'")
    got, want = against_sql(spark, tmp_path, name)
    assert got == want and got


def test_places_of_one_name_count_together(spark):
    """Work on names grows with the distinct ones: copies of a place change hits and suggestions and no number of rows on the way."""
    rows = [(k, ("big red barn", "small red barn", "Casa de la Luz")[k % 3], 0) for k in range(60)] + [(100, "lone oak", 0)]
    places = spark.createDataFrame(rows, "code long, name string, state long")
    asked = [(1, 0, "BIG red barn"), (2, 0, "barn red"), (3, 0, "oak"), (4, 0, "red nowhere"), (5, 0, "de la"), (6, 1, "lone oak")]
    got = {r.wanted_id: r for r in joins.find_place(places, spark.createDataFrame(asked, "wanted_id long, state long, wanted string")).collect()}
    assert {k: (r.hits, r.code, r.how) for k, r in got.items()} == {
        1: (20, None, "several"), 2: (40, None, "several"), 3: (1, 100, "words"), 4: (0, None, "none"), 5: (61, None, "several"), 6: (0, None, "none")
    }
    assert got[4].similar == ["big red barn"] * 15 and got[2].similar == ["big red barn"] * 15
    plan = joins.find_place(places, spark.createDataFrame(asked, "wanted_id long, state long, wanted string"))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    index = next(k for k, line in enumerate(lines) if "Generate explode(array_distinct(split(__own" in line)
    assert any("Aggregate [state" in line for line in lines[index : index + 4])  # the index of words is made of distinct names


def test_blocks_of_a_file_are_cut_without_an_exchange(spark):
    row = lambda v: " ".join(["20240105 600 15.0 -100.0", str(v), "1000", *["10"] * 13])
    text = f"\n\nS1, A, 2,\n{row(1)}\n\n{row(2)}\r\nS2, B, 0,\nS3, C, 1,\n{row(3)}\n"
    out = tables.cloud_blocks(spark.createDataFrame([("f", text), ("g", f"S4, D, 1,\n{row(4)}")], "path string, value string"))
    got = sorted((r.path, r.block, r.storm_id, r.storm_name, r.declared_entries, r.record_number, r.vmax_kt) for r in out.collect())
    assert got == [("f", 2, "S1", "A", 2, 1, 1.0), ("f", 2, "S1", "A", 2, 2, 2.0), ("f", 7, "S3", "C", 1, 1, 3.0), ("g", 0, "S4", "D", 1, 1, 4.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    with pytest.raises(Exception, match="line 1 has no header"):
        tables.cloud_blocks(spark.createDataFrame([("f", row(1))], "path string, value string")).collect()


def test_equal_sums_are_equal_in_any_order(spark, tmp_path):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 are one value, and so is their percentile."""
    values = [(u, k, v) for u, order in enumerate([(0.1, 0.2, 0.3), (0.3, 0.2, 0.1)]) for k, v in enumerate(order)]
    rows = [(8 * 3, T0 + dt.timedelta(hours=6 * u + 1, minutes=k), v) for u, k, v in values]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [r.p6 for r in standins.series(spark, str(tmp_path)).collect()] == [0.6, 0.6]
    tied = spark.createDataFrame([(x,) for x in [0.1] * 3 + [347.33] * 9 + [400.1] * 3], "x double")
    for q in (0.3, 0.55, 0.7, 0.75):
        assert quantiles.type8(tied, [], "x", (q,)).collect()[0][1] == 347.33


def test_declarations_of_a_cell_follow_each_other(spark, tmp_path):
    """3000 declarations of one place and day in four cells: a file holds each cell in a few runs, and so little of it."""
    duckdb.sql(f"COPY (SELECT (175 * k)::BIGINT AS o_orderkey, 0::BIGINT AS o_custkey FROM range(0, 3000) t(k)) TO '{tmp_path}/orders.parquet'")
    duckdb.sql(f"""COPY (SELECT (48 * c)::BIGINT AS user_id, TIMESTAMP '2024-01-01 01:00:00' + to_hours(6 * s::INT) AS ts, (1 + (c * 7 + s * 5) % 9)::DOUBLE AS value
      FROM range(0, 4) t(c), range(0, 8) u(s)) TO '{tmp_path}/events.parquet'""")  # fmt: skip
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where neither side of the join is small
    try:
        got, want = against_sql(spark, tmp_path, "cell_declarations")
        catalog.queries()["cell_declarations"](spark, str(tmp_path)).coalesce(1).write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and len(got) == 12000
    cells = [r.cell for r in spark.read.parquet(f"{tmp_path}/out").select("cell").collect()]
    assert sum(a != b for a, b in zip(cells, cells[1:])) < 4 * 3  # blocks of 1000 of kind D and twice of kind E


def test_each_declaration_keeps_rows_without_an_id_or_a_kind(spark):
    rows = [(k if k else None, 1, "DE"[k % 2] if k % 5 else None, T0, T0) for k in range(2500)] + [(9999, 2, "D", T0, T0)]
    declared = spark.createDataFrame(rows, "id_decl long, place long, kind string, start timestamp, end timestamp")
    by_range = spark.createDataFrame([(1, T0, T0, c, c / 2) for c in range(3)], "place long, start timestamp, end timestamp, cell long, p6_max double")
    got = [tuple(r) for r in D.each_declaration(declared, by_range).select("id_decl", "kind", "cell", "p6_max").collect()]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(got, key=key) == sorted(((i, kind, c, c / 2) for i, p, kind, _, _ in rows if p == 1 for c in range(3)), key=key)


def test_rows_by_cell_of_the_workflow_are_not_written_before_they_are_read(spark, tmp_path, monkeypatch):
    """3000 declarations of one place and day in 40 cells: 120,000 rows of cells, of which what is stored holds none."""
    duckdb.sql(f"COPY (SELECT (175 * k)::BIGINT AS o_orderkey, 0::BIGINT AS o_custkey FROM range(0, 3000) t(k)) TO '{tmp_path}/orders.parquet'")
    duckdb.sql(f"""COPY (SELECT (48 * c)::BIGINT AS user_id, TIMESTAMP '2024-01-01 01:00:00' + to_hours(6 * s::INT) AS ts, (1 + (c * 7 + s * 5) % 9)::DOUBLE AS value
      FROM range(0, 40) t(c), range(0, 8) u(s)) TO '{tmp_path}/events.parquet'""")  # fmt: skip
    monkeypatch.setattr(staging, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    got, want = against_sql(spark, tmp_path, "declared_workflow")
    assert got == want and sum("cells" in r for r in got) == 120_000
    stored = sum(pq.read_metadata(f).num_rows for f in (tmp_path / "shared").rglob("*.parquet"))
    assert stored < 40_000


def test_ranges_of_dates_are_dealt_to_more_tasks_than_a_shuffle_has(spark):
    """60 ranges of one weight: by four partitions a task would hold a quarter of the rows at least."""
    rows = [(k, k % 6, "E", T0 + dt.timedelta(days=k % 10), T0 + dt.timedelta(days=k % 10)) for k in range(600)]
    declared = spark.createDataFrame(rows, "id_decl long, place long, kind string, start timestamp, end timestamp")
    by_range = declared.select(*D.RANGE).distinct().withColumns({"cell": F.lit(1), "p6_max": F.lit(2.0)})
    tasks = D.each_declaration(declared, by_range).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 600 and max(r["count"] for r in tasks) < 150


@pytest.mark.parametrize("name", ["declustered_peaks", "percentile_level", "events_above_threshold", "percentile_intervals", "share_above_percentile", "wet_frequency"])
def test_sums_that_are_compared_go_by_the_rows(spark, tmp_path, name):
    """40 cells of 20 to 59 steps, whose rain is 20 mm in three parts: in one order in two to sixteen the sum is a bit above 20, and
    with it what is above its neighbours, the cell's percentiles or 20 mm."""
    calm, above = (0.1, 0.6, 19.3), (0.1, 19.3, 0.6)
    assert 0.1 + 0.6 + 19.3 == 20.0 < 0.1 + 19.3 + 0.6
    rows = []
    for cell, step in ((c, s) for c in range(40) for s in range(20 + c)):
        for k, v in enumerate(above if (step * 7 + cell) % (2 + cell % 15) == 0 else calm):
            rows.append((8 * cell, T0 + dt.timedelta(hours=6 * step + 1, minutes=k), v))
    table = pa.table({"event_id": range(len(rows)), **dict(zip(("user_id", "ts", "value"), zip(*rows)))})
    pq.write_table(table, f"{tmp_path}/events.parquet")
    got, want = against_sql(spark, tmp_path, name)
    assert got == want and got


def test_between_two_neighbours_lies_one_of_them(spark):
    """Values a bit apart: with their weights rounded once, the quantile is that of the SQL."""
    rows = [(k, x) for k in range(200) for x in (10 + k * 1.37, math.nextafter(10 + k * 1.37, 1e9))]
    levels = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.75, 0.85, 0.9, 0.95)
    got = [tuple(r) for r in quantiles.type7_by_rank(spark.createDataFrame(rows, "cell long, x double"), ["cell"], "x", levels).orderBy("cell").collect()]
    values = pa.table(dict(zip(("cell", "x"), zip(*rows))))
    want = duckdb.sql(f"SELECT cell, {', '.join(f'quantile_cont(x, {q})' for q in levels)} FROM values GROUP BY cell ORDER BY cell").fetchall()
    assert values.num_rows == 400 and got == want


def test_blocks_of_one_range_are_dealt_to_many_tasks(spark):
    """20,000 declarations of one range, a third without a kind: no task makes, or holds, what all of them yield."""
    kind = F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 2 == 0, "D").otherwise("E"))
    dates = spark.createDataFrame([(1, T0, T0)], "place long, start timestamp, end timestamp")
    declared = spark.range(20_000).select(F.col("id").alias("id_decl"), kind.alias("kind")).crossJoin(dates)
    by_range = dates.crossJoin(spark.range(3).withColumnRenamed("id", "cell"))
    out = D.each_declaration(declared, by_range)
    tasks = out.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 60_000 and len(tasks) > 8 and max(r["count"] for r in tasks) <= 20_000
    assert out.select("id_decl", "kind", "cell").exceptAll(declared.crossJoin(spark.range(3)).select("id_decl", "kind", "id")).isEmpty()
