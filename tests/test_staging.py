"""Products that share what is computed once; exact quantiles of large groups."""

import os

import pytest
from pyspark.sql import functions as F

from galerna import jobs
from galerna.operators import extremes, selection
from galerna.plans import case, climatology, declared
from galerna.plans import standins as P
from galerna.sources.staging import Staging, finished

SF = "/root/testdata/sf0.001"


def counted(spark, df, column):
    """``df`` with a column that adds to an accumulator each time that a row of it is computed."""
    total = spark.sparkContext.accumulator(0)

    @F.udf(df.schema[column].dataType)
    def seen(x):
        total.add(1)
        return x

    return df.withColumn(column, seen.asNondeterministic()(F.col(column))), total


def test_return_periods_read_the_series_once(spark, tmp_path):
    s = P.series(spark, SF).withColumn("season", F.month("time")).cache()
    plain = {n: {tuple(r) for r in t.collect()} for n, t in climatology.return_periods(s, 5, min_n=1, min_excess=2).items()}
    own, total = counted(spark, s, "p6")
    with Staging(spark, str(tmp_path / "shared")) as staging:
        made = climatology.return_periods(own, 5, min_n=1, min_excess=2, staged=staging)
        declared.write_tables(made, str(tmp_path / "out"), staging)
        assert not staging.tables  # the last reader has dropped each
    assert total.value == s.count()
    assert not os.path.exists(tmp_path / "shared") or not os.listdir(tmp_path / "shared")
    for n, rows in plain.items():
        assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/{n}.parquet").collect()} == rows, n


def test_declared_reads_each_input_once(spark, tmp_path):
    from galerna.plans import catalog_more

    inputs = {}

    def catching(*given, **options):
        inputs["given"], inputs["options"] = given, options
        return {}

    real, catalog_more.W.run = catalog_more.W.run, catching
    try:
        catalog_more._workflow(spark, SF)
    finally:
        catalog_more.W.run = real
    d, t, places, bridge, s, levels = inputs["given"]
    frames = {"declared": (d, "id_decl"), "tracks": (t, "lat"), "places": (places, "place_lat"), "bridge": (bridge, "cell"), "series": (s, "p6"), "q24": (levels[24], "q75")}
    sizes = {k: df.count() for k, (df, _) in frames.items()}
    seen = {k: counted(spark, df.cache(), c) for k, (df, c) in frames.items()}
    with Staging(spark, str(tmp_path / "shared")) as staging:
        made = real(*(seen[k][0] for k in ("declared", "tracks", "places", "bridge", "series")), {**levels, 24: seen["q24"][0]}, staged=staging)
        assert len(made) == 12
        declared.write_tables(made, str(tmp_path / "out"), staging)
    assert {k: total.value for k, (_, total) in seen.items()} == sizes
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"{n}.parquet" for n in made)


def test_staged_tables_are_named_once_and_dropped(spark, tmp_path):
    with Staging(spark, str(tmp_path)) as staging:
        a = staging("a", spark.range(5))
        with pytest.raises(ValueError, match="already"):
            staging("a", spark.range(5))
        b = staging("b", a.filter("id > 2"))
        assert staging.read_by(a.join(b, "id")) == {"a", "b"} and staging.read_by(b) == {"b"}
        left = []
        staging.write_all({"y": a.join(b, "id"), "x": b}, lambda n, df: left.append((n, df.count(), sorted(staging.tables))))
        assert left == [("y", 2, ["a", "b"]), ("x", 2, ["b"])] and not staging.tables
    assert os.listdir(tmp_path) == []
    assert finished(spark, lambda own: own("c", spark.range(3)).selectExpr("sum(id) AS s")).collect()[0].s == 3


def test_case_reads_its_tracks_stage_once(spark, tmp_path):
    from galerna.plans.snapshot import Settings

    tracks = P.tracks(spark, SF).filter("storm_id = 'S0'").limit(6).cache()
    times = [r.time for r in tracks.select("time").distinct().collect()]
    grid = P.grid(spark, SF)
    series = grid.select("cell").crossJoin(spark.createDataFrame([(t,) for t in times], "time timestamp")).withColumn("p6", F.lit(3.0)).withColumn("r", F.lit(0))
    q = F.create_map(*(x for n in ("Q75", "Q90", "Q95") for x in (F.lit(n), F.lit(1.0))))
    climate = grid.select("cell", q.alias("q6"), q.alias("q24"), q.alias("q72"))
    own, total = counted(spark, tracks, "vmax_kt")
    with Staging(spark, str(tmp_path / "shared")) as staging:
        made = case.run(own, series.drop("r"), grid, climate, P.bridge(spark, SF), {"floor": Settings(), "always": Settings(mode="always")}, staged=staging)
        declared.write_tables(made, str(tmp_path / "out"), staging)
        fields = spark.read.parquet(f"{tmp_path}/out/fields.parquet").count()
    # the storm stage of rejected and near, and that of the experiments
    assert total.value <= 2 * tracks.count() and fields > 0
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"{n}.parquet" for n in made)


@pytest.mark.parametrize("gather", [50, 2000, 10**6])
def test_quantiles_of_large_groups(spark, gather):
    hot = F.when(F.rand(1) < 0.6, 0).otherwise(F.col("id") % 7)
    df = spark.range(40_000).select(
        hot.alias("g"), F.when(F.col("id") % 11 != 0, F.exp(20 * F.randn(3)) * F.signum(F.randn(5))).alias("x"), F.when(F.rand(8) < 0.7, 1.5).otherwise(F.floor(F.rand(9) * 50)).alias("y"),
    ).unionByName(spark.createDataFrame([(9, None, None), (10, 2.0, None), (11, 1.0, 3.0), (11, 4.0, 3.0)], "g long, x double, y double")).cache()
    wanted = {"m": (F.col("x"), 0.5), "p90": (F.col("x"), 0.9), "low": (F.col("x"), 0.0), "high": (F.col("x"), 1.0), "y50": (F.col("y"), 0.5), "y93": (F.abs("y"), 0.93)}
    want = {r.g: tuple(r)[1:] for r in df.groupBy("g").agg(*(F.percentile(x, F.lit(q)) for x, q in wanted.values())).collect()}
    with Staging(spark) as staging:
        got = {r.g: tuple(r)[1:] for r in selection.quantiles(df, ["g"], wanted, staging, gather).collect()}
        first = [n for n in staging.tables if n.endswith("-0-kept")]
        if gather == 50:  # the first round alone leaves a fiftieth of a group whose values differ: no task reads a group
            kept = spark.read.parquet(staging.tables[first[0]]).filter("name in ('m', 'p90')").groupBy("g", "name").count()
            size = {r.g: r["count"] for r in df.filter("x is not null").groupBy("g").count().collect()}
            assert all(r["count"] < size[r.g] / 50 for r in kept.collect())
        assert len(first) == (gather < 10**6)
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12) if None not in want[g] else got[g] == want[g], g


def test_summaries_select_their_medians(spark):
    fits = spark.createDataFrame([("a", 0.1, True), ("a", 0.3, False), ("a", 0.2, False), ("b", None, None), ("b", -0.1, False)], "family string, xi double, clipped boolean")
    out = {r.family: r for r in finished(spark, lambda own: extremes.shape_summary(fits, ["family"], own)).collect()}
    assert out["a"].median == pytest.approx(0.2) and out["a"].clipped_share == pytest.approx(1 / 3) and out["b"].median == -0.1


def test_common_axis_of_a_season(spark):
    step = lambda k: f"2024-05-01 {6 * k:02d}:00:00"
    rows = [(1, 2024, step(k), float(k)) for k in range(4)] + [(2, 2024, step(k), 9.0) for k in (1, 2)]
    df = spark.createDataFrame(rows, "cell long, season int, time string, r double").withColumn("time", F.col("time").cast("timestamp"))
    out = {r.cell: r for r in extremes.seasonal_maximum(df, ["cell"], "r", min_valid=0.75, time="time").collect()}
    assert out[1].maximum == 3.0 and out[2].maximum is None and out[2].n_rows == 4 and out[2].n_valid == 2


def test_returns_job_takes_a_staging(spark):
    s = P.series(spark, SF).withColumn("season", F.lit(2024))
    with Staging(spark) as own:
        assert set(jobs.returns(s, staged=own)) >= {"gev", "gpd", "maxima"}


def test_products_carry_units_and_serve_as_views(spark, tmp_path):
    s = P.series(spark, SF).withColumn("season", F.lit(2024))
    made = {n: climatology.with_product_units(t) for n, t in jobs.returns(s).items()}
    made["maxima"].write.parquet(f"{tmp_path}/m")
    units = {f.name: f.metadata.get("units") for f in spark.read.parquet(f"{tmp_path}/m").schema}
    assert units["maximum"] == "mm" and units["n_valid"] == "1" and units["cell"] is None
    assert {f.name: f.metadata.get("units") for f in made["gpd"].schema}["rate"] == "1/season"
    assert climatology.as_views({"maxima": made["maxima"]}, "run") == ["run_maxima"]
    assert spark.sql("SELECT count(*) AS n FROM run_maxima").head().n == made["maxima"].count()
