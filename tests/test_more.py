"""Times with fractions, tracks, readers, summaries, options and jobs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_functions import Profile, one, root

from galerna import config, jobs
from galerna.functions import basic, geometry, wind
from galerna.functions import text as X
from galerna.functions import time as tm
from galerna.operators import extremes, joins, rain, tracks
from galerna.plans import catalog_more
from galerna.plans import declared as W
from galerna.plans import snapshot
from galerna.sources import tables

T0 = dt.datetime(2020, 5, 1, 6)
STEP = dt.timedelta(hours=6)


def test_fractions_of_a_second(spark):
    t = dt.datetime(2024, 1, 25, 18)
    ends = one(spark, *(tm.window_end(F.lit(t + dt.timedelta(microseconds=u)), label_is="end") for u in (-1, 0, 1, 500_000)), x=1)
    assert ends == (t, t, t + STEP, t + STEP)
    early = dt.datetime(1960, 1, 1, 0, 0, 0, 1)
    assert one(spark, tm.window_end(F.lit(early), label_is="end"), tm.to_utc(F.lit(t + dt.timedelta(microseconds=7)), -6), x=1) == (
        dt.datetime(1960, 1, 1, 6), t + STEP + dt.timedelta(microseconds=7))
    series = spark.createDataFrame([(0, t), (0, t + dt.timedelta(hours=4))], "cell int, time timestamp")
    targets = spark.createDataFrame([(1, 0, t + dt.timedelta(hours=2, microseconds=1)), (2, 0, t + dt.timedelta(hours=2)), (3, 0, t - dt.timedelta(hours=2, microseconds=1))],
                                    "target_id int, cell int, target_time timestamp")
    got = {r.target_id: (r.time, r.gap_s) for r in joins.nearest_in_time(targets, series, ["cell"], 7200).collect()}
    assert got == {1: (t + dt.timedelta(hours=4), 7199.999999), 2: (t, 7200.0)}


def test_batch_and_stream_sums_agree_on_missing_values(spark):
    rows = [(0, T0 + dt.timedelta(hours=h), v) for h, v in enumerate([1.0, 2.0, 3.0, 1.0, 1.0, 1.0, float("nan"), -1.0, 1.0, 1.0, 1.0, 1.0])]
    got = rain.accumulate(spark.createDataFrame(rows, "cell int, time timestamp, p double"), ["cell"]).orderBy("time").collect()
    assert [(r.p6, r.n) for r in got] == [(9.0, 6), (None, 4)]


def test_one_row_or_an_error(spark):
    df = spark.createDataFrame([("a", "ODA", 2001, T0), ("b", "ODA", 2002, T0), ("c", "ODA", 2002, T0)], "storm_id string, name string, season int, time timestamp")
    assert [r.storm_id for r in tracks.storm_named(df, "ODA", 2001).collect()] == ["a"]
    for wrong, say in ((tracks.storm_named(df, "ODA", 2002), "2 rows"), (tracks.storm_named(df, "EVA", 2002), "0 rows"),
                       (tracks.position_at(df, "a", F.lit(T0 + STEP)), "0 rows"), (tracks.position_at(df, "a", F.lit(T0 + STEP), 2.0), "0 rows")):
        with pytest.raises(Exception, match=say):
            wrong.collect()
    near = df.unionByName(df.withColumn("time", F.col("time") + F.expr("interval 2 hours")))
    assert [r.time for r in tracks.position_at(near, "a", F.lit(T0 + dt.timedelta(hours=1)), 1.0).collect()] == [T0]
    hours = spark.createDataFrame([(0,), (6,), (600,), (700,), (1800,)], "hh int")
    assert [r.hh for r in tracks.at_hours(hours).collect()] == [0, 6, 600, 1800]
    arrays = spark.createDataFrame([(bytearray(b"A "),), (bytearray(b"B"),), (bytearray(b"B"),)], "sid binary")
    assert tables.storm_arrays(arrays, "A").count() == 1
    with pytest.raises(Exception, match="2 rows"):
        tables.storm_arrays(arrays, "B").collect()


def test_parametric_radii(spark):
    rows = [("a", 90.0, 18.0, 30.0, 120.0, 100.0, 0.0, None), ("b", 40.0, 25.0, None, None, None, None, None), ("c", None, 10.0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "storm_id string, vmax_kt double, lat double, rmw_km double, r34_rne double, r34_rse double, r34_rsw double, r34_rnw double")
    got = {r.storm_id: r for r in tracks.with_parametric_radii(df, {"r25_km": 25.0}, use_rmw=True).collect()}
    p = Profile(90 * 0.514444, 18.0, 30.0)
    assert got["a"].w06_r25_km == pytest.approx(root(lambda r: p(r) - 25, p.rmax, wind.SEARCH_KM), abs=1e-3) and not got["a"].w06_x1_calibrated
    assert got["b"].w06_r25_km is None and got["b"].w06_rmax_km > 0 and got["c"].w06_rmax_km is None
    fitted = {r.storm_id: r for r in tracks.with_parametric_radii(df, {"r34_km": 17.491096}, use_rmw=True, calibrate=True).collect()}
    assert fitted["a"].w06_x1_calibrated and fitted["a"].w06_r34_km == pytest.approx(110 * 1.852, abs=0.1) and not fitted["b"].w06_x1_calibrated


def test_cloud_readers(spark, tmp_path):
    line = "20000613 0600 11.0 -100.1 35 1005 100 -9999 0 130 115 .1 .2 .3 1 2 3 4 2.5"
    files = spark.createDataFrame([("f", f"\n A, BUD, 2,\n{line}\nA, BUD, 1,\n{line}"), ("g", "9 8 2013 6"), ("h", "")], "path string, value string")
    assert {r.path: r.is_block for r in tables.is_block_layout(files).collect()} == {"f": True, "g": False, "h": False}
    with pytest.raises(ValueError, match="A: declared 2, found 1"):
        tables.cloud_texts(files.filter("path = 'f'"), check=True)
    good = files.filter("path = 'f'").withColumn("value", F.regexp_replace("value", "BUD, 2", "BUD, 1"))
    assert tables.cloud_texts(good, synoptic_only=True, check=True).count() == 2
    flat = spark.createDataFrame([("9,8,2013,600, 11.0,-116.2,185.2,1008,0,-3,679.67,713.31,640.31,0.24,0.51,0.31,CP032013",)], "value string")
    r = tables.cloud_comma(flat).head()
    assert r.vmax_kt_cloud == pytest.approx(100.0) and r.rocloud_rne is None and r.rocloud_rnw is None and r.rocloud_rsw == 679.67
    hours = spark.createDataFrame([(T0, T0, T0 + STEP), (T0 + STEP, T0, T0 + STEP)], "t timestamp, a timestamp, b timestamp")
    assert [r[0] for r in hours.select(tables.label_convention(F.col("t"), F.col("a"), F.col("b"))).collect()] == ["start", "end"]
    with pytest.raises(Exception, match="within its interval"):
        hours.select(tables.label_convention(F.col("a") + F.expr("interval 3 hours"), F.col("a"), F.col("b"))).collect()
    (tmp_path / "b.nc").write_bytes(b"x")
    (tmp_path / "a.nc4").write_bytes(b"xy")
    (tmp_path / "c.txt").write_text("no")
    assert [r.path.rsplit("/", 1)[1] for r in tables.rain_files(spark, str(tmp_path)).collect()] == ["a.nc4", "b.nc"]
    years = spark.createDataFrame([(2001,), (2002,)], "season int")
    assert tables.seasons(years, (2001,)).count() == 1
    with pytest.raises(ValueError, match="2003"):
        tables.seasons(years, (2001, 2003))
    assert tables.associated(spark, str(tmp_path / "none.csv")) is None
    chars = lambda t: [bytearray(x.encode()) for x in t]
    cube = spark.createDataFrame([(chars("2020A "), [chars("2020-08-01 00:00:00")], [10.0], [-100.0], [50.0], [990.0], [20.0], [[60.0, 50.0, None, 40.0]])],
                                 "sid array<binary>, iso_time array<array<binary>>, lat array<double>, lon array<double>, usa_wind array<double>, usa_pres array<double>, usa_rmw array<double>, usa_r34 array<array<double>>")
    assert [(b.storm_id, b.time) for b in tables.best_tracks(cube).collect()] == [("2020A", dt.datetime(2020, 8, 1))]
    both = tables.cloud_tracks([r_table := spark.createDataFrame([("a", T0, 0.0, 1.0, 1.0, 1.0), ("a", T0 + STEP / 2, 5.0, 1.0, 1.0, 1.0)], "storm_id string, time timestamp, rocloud_rne double, rocloud_rse double, rocloud_rsw double, rocloud_rnw double"), r_table])
    assert [x.rocloud_rne for x in both.collect()] == [None, None]
    text = "Id,Clase,Notas,Clave,Tipo,Inicio,Fin\n7,Hidrometeorol\u00f3gico,\"Lluvia por el Hurac\u00e1n \"\"Odile\"\"\",3008,E,14/09/2014,15/09/2014\n"
    (tmp_path / "d.csv").write_bytes(text.encode("latin-1"))
    names = dict(zip(("Id", "Clase", "Notas", "Clave", "Tipo", "Inicio", "Fin"), ("id", "class", "notes", "place_code", "kind", "start", "end")))
    d = tables.declarations_csv(spark, str(tmp_path / "d.csv"), names, rain_only=True).head()
    assert (d.id_decl, d.place, d.storm_name, d.end) == (7, "03008", "ODILE", dt.datetime(2014, 9, 15))


def test_letters_with_marks(spark):
    assert one(spark, X.without_accents(F.lit("ýžšőűŁßệñÇÅ")), X.comparable(F.lit(" Žluťoučký  kůň ")), x=1) == ("yzsouŁßenCA", "zlutoucky kun")


def test_class_labels(spark):
    assert one(spark, *(basic.class_label(F.lit(x)) for x in (0.0, 0.2, 1.0)), basic.class_label(F.lit(None).cast("double")), x=1) == ("0 No hazard / exterior", "1 Very low", "5 Extreme", None)


def test_points_and_masks(spark):
    ring = lambda *p: [{"lat": a, "lon": b} for a, b in p]
    rings = [("square", ring((0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0))), ("u", ring((0.0, 0.0), (0.0, 9.0), (5.0, 9.0), (5.0, 6.0), (1.0, 6.0), (1.0, 1.0), (5.0, 1.0), (5.0, 0.0)))]
    df = spark.createDataFrame(rings, "place string, ring array<struct<lat:double,lon:double>>").withColumn("p", geometry.representative_point(F.col("ring")))
    got = {r.place: (r.p.lat, r.p.lon) for r in df.collect()}
    assert got["square"] == pytest.approx((1.0, 1.0)) and got["u"] == pytest.approx((2.5, 7.5))
    cells = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 4.0, 8.0)], "cell int, cell_lat double, cell_lon double")
    boxes = df.select("place", "ring", F.col("p.lat").alias("place_lat"), F.col("p.lon").alias("place_lon"))
    assert {r.cell: r.inside for r in joins.in_polygons(cells, boxes.withColumn("rings", F.array("ring"))).collect()} == {1: True, 2: False, 3: True}
    places = spark.createDataFrame([("01001", "La Paz", "B")], "code string, name string, state string")
    wanted = spark.createDataFrame([(1, "la paz", "B", None), (2, "Elsewhere", "B", "01001"), (3, "Nowhere", "B", "77777")], "wanted_id int, wanted string, state string, known string")
    assert {(r.wanted_id, r.code, r.how) for r in joins.find_place(places, wanted, "known").collect()} == {(1, "01001", "exact"), (2, "01001", "code"), (3, None, "none")}


def test_percentile_intervals_by_the_distribution(spark):
    q = spark.createDataFrame([(1, 5.0, 20.0), (2, 5.0, None)], "cell int, q75 double, q95 double")
    fits = spark.createDataFrame([(1, 10.0, 4.0, 0.0, 2.0)], "cell int, u double, sigma double, xi double, rate double")
    got = {(r.cell, r.percentile): r.years for r in extremes.percentile_intervals(q, fits, ["cell"], ["q75", "q95"]).collect()}
    assert got[1, "q75"] == 0.1 and got[1, "q95"] == pytest.approx(2.718281828**2.5 / 2, rel=1e-6) and got[2, "q75"] is None and got[2, "q95"] is None
    peaks = spark.createDataFrame([(1, 6.0), (3, 9.0)], "cell int, r double")
    assert {r.cell: r.n_q75 for r in extremes.counts_at_least(peaks, q, ["cell"], "r", ["q75"]).collect()} == {1: 1, 3: 0}


def test_absent_steps_count_as_missing(spark):
    rows = [(0, 1, T0 + k * STEP, float(k)) for k in range(9) if k not in (2, 3)] + [(0, 2, T0 + k * STEP, 1.0) for k in range(9)]
    df = spark.createDataFrame(rows, "cell int, season int, time timestamp, r double")
    got = {r.season: (r.maximum, r.n_rows) for r in extremes.seasonal_maximum(df, ["cell"], "r", time="time").collect()}
    assert got == {1: (None, 9), 2: (1.0, 9)}


def test_options(tmp_path):
    assert config.ReturnOptions().k == 78 and config.options_of(config.PercentileOptions, {"durations": [6, 24]}).durations == (6, 24)
    with pytest.raises(ValueError, match="hours2"):
        config.options_of(config.RainOptions, {"hours2": 1})
    with pytest.raises(ValueError):
        config.PercentileOptions(durations=(5,))
    case = config.CaseOptions("X", {"a": {}, "b": {"radii": {"mode": "always"}}})
    assert {k: s.mode for k, s in case.settings().items()} == {"a": config.Settings().mode, "b": "always"}
    assert config.settings(config.default()) == config.Settings()


def test_jobs(spark, tmp_path):
    rng = random.Random(2)
    start = lambda y: dt.datetime(y, 5, 1)
    hourly = [(c, start(y) + dt.timedelta(hours=h), rng.gammavariate(0.3, 4)) for c in range(2) for y in (2001, 2002) for h in range(240)]
    spark.createDataFrame(hourly, "cell int, valid_time timestamp, precipitation double").write.parquet(str(tmp_path / "hourly"))
    jobs.main(["rain", "--table", f"hourly={tmp_path}/hourly", "--out", str(tmp_path / "rain")])
    series = spark.read.parquet(str(tmp_path / "rain/series"))
    assert series.filter("p6 is not null").count() == 2 * 2 * 40
    assert spark.read.parquet(str(tmp_path / "rain/incomplete.parquet")).count() == 0
    (tmp_path / "c.yaml").write_text("percentiles: {levels: [0.75, 0.9], durations: [6, 24]}\nreturns: {min_seasons: 2, min_excesses: 2}\n")
    for job in ("percentiles", "returns"):
        jobs.main([job, "--table", f"series={tmp_path}/rain/series", "--out", str(tmp_path / job), "--config", str(tmp_path / "c.yaml")])
    assert spark.read.parquet(str(tmp_path / "percentiles/by_hour.parquet")).select("hour").distinct().count() == 5
    assert spark.read.parquet(str(tmp_path / "returns/maxima.parquet")).count() == 2 * 3 * 2
    with pytest.raises(ValueError, match="inside"):
        jobs.main(["returns", "--table", f"series={tmp_path}/rain", "--out", str(tmp_path / "rain/x")])
    made = []
    compute = lambda: made.append(1) or spark.range(3)
    for force in (False, False, True):
        assert jobs.computed_once(spark, str(tmp_path / "cache"), compute, force).count() == 3
    assert len(made) == 2


def test_declared_workflow_writes_twelve_tables(spark, tmp_path):
    tables_made = catalog_more._workflow(spark, "/root/testdata/sf0.01")
    assert len(tables_made) == 12
    some = {k: tables_made[k] for k in ("unplaced", "events", "cells", "summary", "table_a72")}
    W.write_tables(some, str(tmp_path))
    events = spark.read.parquet(f"{tmp_path}/events.parquet")
    assert events.filter("p_event is null and n_steps_data > 0").count() == 0 and events.filter("p_areal > p_event").count() == 0
    assert events.filter("level_r24_area_event < level_r24_event").count() == 0
    shares = spark.read.parquet(f"{tmp_path}/table_a72.parquet").groupBy("kind").agg(F.sum("share").alias("s")).collect()
    assert shares and all(abs(r.s - 1) < 1e-9 for r in shares)
    assert [r.place for r in spark.read.parquet(f"{tmp_path}/unplaced.parquet").collect()] == [5]


def test_experiments_share_profiles_and_the_join(spark):
    rng = random.Random(1)
    t = spark.createDataFrame([("x", T0, 20.0, -95.0, 95.0, 30.0, 120.0, None, 60.0, 80.0, 300.0, 0.0, 500.0, None)],
                              "storm_id string, time timestamp, lat double, lon double, vmax_kt double, rmw_km double, r34_rne double, r34_rse double, r34_rsw double, r34_rnw double, "
                              "rocloud_rne double, rocloud_rse double, rocloud_rsw double, rocloud_rnw double")  # fmt: skip
    q = lambda *v: F.create_map(*(x for n, y in zip(("Q75", "Q90", "Q95"), v) for x in (F.lit(n), F.lit(float(y)))))
    cells = spark.createDataFrame([(60 * i + j, T0, 14 + i * 0.8, -101 + j * 0.8, rng.gammavariate(0.6, 12), rng.random() * 70, rng.random() * 60) for i in range(15) for j in range(15)],
                                  "cell int, time timestamp, cell_lat double, cell_lon double, p6 double, r24 double, a72 double")
    cells = cells.withColumns({"q6": q(8, 18, 28), "q24": q(20, 40, 55), "q72": q(30, 60, 80)})
    settings = {m: snapshot.Settings(mode=m) for m in ("never", "floor", "always")}
    rows = lambda df: sorted((r.experiment, r.cell, round(r.h_total, 9), round(r.r_attr, 6)) for r in df.collect())
    together = snapshot.experiments(t, cells, settings)
    apart = {k: snapshot.snapshot(t, cells, s).withColumn("experiment", F.lit(k)) for k, s in settings.items()}
    assert rows(together) == sorted(x for df in apart.values() for x in rows(df))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(together).count("Exchange") <= plan(apart["floor"]).count("Exchange")
    assert rows(snapshot.experiments(t, cells, {"a": snapshot.Settings(), "b": snapshot.Settings(alpha=0.5)}))


def test_case_and_declared_jobs(spark, tmp_path):
    rng = random.Random(3)
    cells = [(c, 14.0 + c % 4, -101.0 + c // 4) for c in range(16)]
    spark.createDataFrame(cells, "cell long, cell_lat double, cell_lon double").write.parquet(f"{tmp_path}/grid")
    rain_rows = [(c, T0 + k * STEP, rng.gammavariate(0.5, 8)) for c, _, _ in cells for k in range(30)]
    spark.createDataFrame(rain_rows, "cell long, time timestamp, p6 double").write.parquet(f"{tmp_path}/series")
    q = lambda k: F.create_map(*(x for n, v in (("Q75", 2.0), ("Q90", 8.0), ("Q95", 14.0)) for x in (F.lit(n), F.lit(v * k))))
    spark.createDataFrame(cells, "cell long, a double, b double").select("cell", q(1).alias("q6"), q(3).alias("q24"), q(6).alias("q72")).write.parquet(f"{tmp_path}/climatology")
    spark.createDataFrame([(c % 3, c, 1) for c, _, _ in cells], "place long, cell long, n_centres int").write.parquet(f"{tmp_path}/bridge")
    track = [("X", T0 + k * STEP, 15.0, -99.0 + 0.1 * k, 70.0, 40.0, 90.0, 80.0, 70.0, 60.0, 300.0, 310.0, 320.0, 330.0) for k in range(16, 20)]
    names = "storm_id string, time timestamp, lat double, lon double, vmax_kt double, rmw_km double, r34_rne double, r34_rse double, r34_rsw double, r34_rnw double"
    tracks_df = spark.createDataFrame(track, f"{names}, rocloud_rne double, rocloud_rse double, rocloud_rsw double, rocloud_rnw double")
    tracks_df.write.parquet(f"{tmp_path}/tracks")
    (tmp_path / "c.yaml").write_text("case: {storm_id: X, experiments: {floor: {}, always: {radii: {mode: always}}}}\n")
    given = lambda *n: [x for name in n for x in ("--table", f"{name}={tmp_path}/{name}")]
    jobs.main(["case", *given("tracks", "series", "grid", "climatology", "bridge"), "--out", f"{tmp_path}/case", "--config", str(tmp_path / "c.yaml")])
    fields = spark.read.parquet(f"{tmp_path}/case/fields.parquet")
    assert fields.select("experiment").distinct().count() == 2 and fields.filter("h_total > 0").count() > 0
    tracks_df.select("storm_id", "time", "lat", "lon", F.struct(*(F.col(f"rocloud_{q}").alias(q) for q in ("rne", "rse", "rsw", "rnw"))).alias("radii")).write.parquet(f"{tmp_path}/radii")
    spark.createDataFrame([(k, k, f"place {k}", 15.0, -99.0) for k in range(3)], "place long, i int, name string, place_lat double, place_lon double").write.parquet(f"{tmp_path}/places")
    day = dt.datetime(2020, 5, 5)
    spark.createDataFrame([(k, k % 4, "E" if k % 2 else "D", "s", f"note {k}", day, day) for k in range(9)], "id_decl long, place long, kind string, state string, notes string, start timestamp, end timestamp").write.parquet(f"{tmp_path}/declared")
    for h in (6, 24, 72):
        spark.createDataFrame([(c, 1.0 * h, 2.0 * h, 3.0 * h) for c, _, _ in cells], "cell long, q75 double, q90 double, q95 double").write.parquet(f"{tmp_path}/percentiles_{h}")
    tables_given = [*given("declared", "places", "bridge", "series", "percentiles_6", "percentiles_24", "percentiles_72"), "--table", f"tracks={tmp_path}/radii"]
    jobs.main(["declared", *tables_given, "--out", f"{tmp_path}/products"])
    assert len(list((tmp_path / "products").glob("*.parquet"))) == 12
    storms = spark.read.parquet(f"{tmp_path}/products/storms.parquet").collect()
    assert [(s.storm, s.n, s.notes.split(" | ")[0]) for s in storms] == [("X", 7, "note 0")]
