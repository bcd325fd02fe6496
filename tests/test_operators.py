"""Operators on small fixtures with known results."""

import datetime as dt
import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from galerna import config
from galerna.operators import declarations, extremes, joins, municipal, quality, quantiles, rain, sets
from galerna.plans import climatology, snapshot
from galerna.sources import tables
from galerna.sources.staging import finished
from galerna.streaming import rain as stream_rain

T0 = dt.datetime(2021, 5, 1, 6)
STEP = dt.timedelta(hours=6)


def series(spark, values, start=T0, cell=0):
    return spark.createDataFrame([(cell, start + k * STEP, None if v is None else float(v)) for k, v in enumerate(values)], "cell int, time timestamp, p6 double")


def test_accumulation_needs_every_hour(spark):
    rows = [(0, T0 + dt.timedelta(hours=k), 1.0) for k in range(12) if k != 7] + [(1, T0 + dt.timedelta(hours=k), -5.0 if k == 2 else 2.0) for k in range(6)]
    df = spark.createDataFrame(rows, "cell int, time timestamp, p double")
    got = {(r.cell, r.time): r.p6 for r in rain.accumulate(df, ["cell"]).collect()}
    assert got == {(0, T0 + STEP): 6.0, (0, T0 + 2 * STEP): None, (1, T0 + STEP): None}


def test_rolling_sums_do_not_reach_over_gaps(spark):
    a = series(spark, [1] * 4, dt.datetime(2020, 11, 30)).unionByName(series(spark, [1] * 20))
    rows = rain.with_durations(a, ["cell"]).orderBy("time").collect()
    assert [i for i, r in enumerate(rows) if r.r24 is None] == [0, 1, 2, 4, 5, 6] and rows[7].r24 == 4.0
    assert [i for i, r in enumerate(rows) if r.a72 is not None] == list(range(16, 24)) and rows[16].a72 == 12.0
    assert rain.gap_filled(series(spark, [1, 2]).unionByName(series(spark, [3], T0 + 4 * STEP)), ["cell"]).count() == 5


def test_peaks(spark):
    x = [0, 5, 9, 7, 0, 0, 0, 0, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0.5, 0]
    for s, want in ((3, [2, 8, 15]), (6, [2, 15])):
        got = rain.declustered(series(spark, x), ["cell"], 6 * s, "p6").collect()
        assert sorted((r.time - T0) // STEP for r in got) == want


def test_quantiles(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(c, rng.random() * 50) for c in range(3) for _ in range(41)] + [(0, None)], "cell int, x double")
    rows = {r.cell: r for r in quantiles.type8(df, ["cell"], "x", (0.1, 0.75, 0.999)).collect()}
    for c in range(3):
        v = sorted(r.x for r in df.filter(F.col("cell") == c).collect() if r.x is not None)
        for q, name in ((0.1, "q10"), (0.75, "q75"), (0.999, "q99_9")):
            h = min(max((len(v) + 1 / 3) * q + 1 / 3, 1), len(v))
            low = int(h)
            assert rows[c][name] == pytest.approx(v[low - 1] + (h - low) * (v[min(low, len(v) - 1)] - v[low - 1]))
    t7 = quantiles.type7(spark.createDataFrame([(0, float(x)) for x in (0, 10, 20, 30, 40)], "cell int, x double"), ["cell"], "x", (0.5, 0.9)).head()
    assert tuple(t7) == (0, 20.0, 36.0)
    with pytest.raises(ValueError):
        quantiles.check_levels((1.5,))


def test_l_moments_and_fits(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    for xi in (-0.15, 0.15):
        x = 80 + 20 / xi * ((-np.log(rng.random(20_000))) ** -xi - 1)
        fit = extremes.gev_fits(spark.createDataFrame([(0, float(v)) for v in x], "cell int, maximum double"), ["cell"]).head()
        assert fit.xi == pytest.approx(xi, abs=0.02) and fit.sigma == pytest.approx(20, rel=0.03) and fit.mu == pytest.approx(80, rel=0.01)
    few = extremes.l_moments(spark.createDataFrame([(0, 1.0), (0, 2.0)], "cell int, x double"), ["cell"], "x").head()
    assert few.l1 is None and few.n == 2
    top = spark.createDataFrame([(0, 80.0 - 75.0 * k / 78, k + 1) for k in range(79)], "cell int, r double, rank int")
    gpd = extremes.gpd_fits(top, spark.createDataFrame([(0, 26)], "cell int, n_seasons int"), ["cell"], "r").head()
    assert gpd.u == pytest.approx(5.0) and gpd.rate == pytest.approx(3.0)
    assert extremes.gpd_fits(top.filter("rank <= 10"), spark.createDataFrame([(0, 26)], "cell int, n_seasons int"), ["cell"], "r").head().u is None
    ladder = spark.createDataFrame([(0, 101.0 - k, k) for k in range(1, 101)], "cell int, r double, rank int")
    levels = extremes.empirical_levels(ladder, spark.createDataFrame([(0, 10)], "cell int, n_seasons int"), ["cell"], "r", 100, (10.0, 1.0, 0.5, 0.05)).collect()
    assert {r.recurrence: r.level for r in levels} == {10.0: 100.0, 1.0: 91.0, 0.5: 81.0, 0.05: None}


def test_return_periods_plan(spark):
    rng = random.Random(4)
    rows = [(c, y, dt.datetime(y, 5, 1, 6) + k * STEP, rng.gammavariate(0.5, 6)) for c in range(2) for y in range(2000, 2026) for k in range(40)]
    df = spark.createDataFrame(rows, "cell int, season int, time timestamp, p6 double")
    out = climatology.return_periods(df, 20, (6, 24), min_excess=10)
    top = sorted((r.r for r in out["top"].filter("cell = 0 and duration = 6").collect()), reverse=True)
    want = []
    for y in range(2000, 2026):
        x = [r[3] for r in rows if r[0] == 0 and r[1] == y]
        want += [v for i, v in enumerate(x) if v >= 1 and all(v > w for w in x[max(0, i - 8) : i]) and all(v >= w for w in x[i + 1 : i + 9])]
    assert top == pytest.approx(sorted(want, reverse=True)[:21])
    assert out["gev"].count() == 4 and out["pot_levels"].count() == 4 * 9 and out["maxima"].filter("maximum is null").count() == 0  # 24 h lacks 3 of 40 steps: 92.5 % valid
    wet = climatology.wet_percentiles(df, (6,), (0.75, 0.9)).collect()
    assert len(wet) == 2 and all(0 < r.wet_freq < 1 and r.q75 < r.q90 and 0 < r.share90 < r.share75 < 1 for r in wet)


def test_lead_times(spark):
    classes = [3, 1, 2, 3, 3, 4, 5, 5]
    t = dt.datetime(2013, 9, 14)
    s = spark.createDataFrame([("m", t + k * STEP, c) for k, c in enumerate(classes)], "place string, time timestamp, class int")
    e = spark.createDataFrame([("m", dt.datetime(2013, 9, 15, 14, 30)), ("none", t)], "place string, t_event timestamp")
    got = {(r.place, r.level): r for r in municipal.lead_times(s, e, ["place"]).collect()}
    three = got["m", 3]
    assert (three.first_time, three.episode_start, three.lead_h, three.since_end_h) == (t, t + 3 * STEP, 20.5, 2.5)
    assert got["m", 4].lead_h == 8.5 and got["m", 5].lead_h == 2.5 and got["none", 2].lead_h is None and len(got) == 8


def test_polygons_and_places(spark):
    cells = spark.createDataFrame([(10 * i + j, float(i), float(j)) for i in range(10) for j in range(10)], "cell int, cell_lat double, cell_lon double")
    ring = lambda *p: [{"lat": a, "lon": b} for a, b in p]
    polygons = spark.createDataFrame(
        [("square", 3.0, 3.0, ring((1.5, 1.5), (1.5, 4.5), (4.5, 4.5), (4.5, 1.5))), ("l", 7.0, 7.0, ring((5.5, 5.5), (5.5, 8.5), (6.5, 8.5), (6.5, 6.5), (8.5, 6.5), (8.5, 5.5))), ("dot", 0.2, 0.3, ring((0.1, 0.1), (0.1, 0.3), (0.3, 0.2)))],
        "place string, place_lat double, place_lon double, ring array<struct<lat:double,lon:double>>",
    )
    got = {}
    shapes = polygons.withColumn("rings", F.array("ring"))
    for r in finished(spark, lambda own: joins.polygon_cells(shapes, cells, own)).collect():
        got.setdefault((r.place, r.n_centres), set()).add(r.cell)
    assert got == {("square", 9): {10 * i + j for i in (2, 3, 4) for j in (2, 3, 4)}, ("l", 5): {66, 67, 68, 76, 86}, ("dot", 0): {0}}
    places = spark.createDataFrame([("01001", "San José del Cabo", "BCS"), ("01002", "La Paz", "BCS")], "code string, name string, state string")
    wanted = spark.createDataFrame([(1, "la paz", "BCS"), (2, "San Jose", "BCS"), (3, "Nowhere", "BCS")], "wanted_id int, wanted string, state string")
    assert {(r.wanted_id, r.code, r.how) for r in joins.find_place(places, wanted).collect()} == {(1, "01002", "exact"), (2, "01001", "words"), (3, None, "none")}


def test_storm_cells_over_the_date_line(spark):
    t = spark.createDataFrame([("a", 10.0, 179.9), ("b", 89.5, 0.0)], "storm_id string, lat double, lon double")
    c = spark.createDataFrame([(1, 10.0, -179.9), (2, 10.0, 170.0), (3, 89.5, 180.0)], "cell int, cell_lat double, cell_lon double")
    assert {(r.storm_id, r.cell) for r in joins.storm_cells(t, c, 120.0).collect()} == {("a", 1), ("b", 3)}


def test_snapshot_and_quality(spark):
    tracks = spark.createDataFrame([("x", T0, 20.0, -95.0, 95.0, 30.0, 120.0, 100.0, 60.0, 80.0), ("x", T0 + STEP, 20.0, -95.0, None, None, None, None, None, None)],
                                   "storm_id string, time timestamp, lat double, lon double, vmax_kt double, rmw_km double, r34_rne double, r34_rse double, r34_rsw double, r34_rnw double")
    q = lambda *v: F.create_map(*(x for n, y in zip(("Q75", "Q90", "Q95"), v) for x in (F.lit(n), F.lit(float(y)))))
    rng = random.Random(0)
    cells = spark.createDataFrame([(60 * i + j, T0, 12 + i * 0.4, -105 + j * 0.4, rng.gammavariate(0.6, 12), rng.random() * 70, rng.random() * 60) for i in range(40) for j in range(50)],
                                  "cell int, time timestamp, cell_lat double, cell_lon double, p6 double, r24 double, a72 double")
    cells = cells.withColumns({"q6": q(8, 18, 28), "q24": q(20, 40, 55), "q72": q(30, 60, 80)})
    out = snapshot.snapshot(tracks, cells).cache()
    whole = snapshot.snapshot(tracks, cells, snapshot.Settings(whole_grid=True)).cache()
    assert whole.count() == 2000 and out.count() < 2000
    assert out.count() >= whole.filter("h_total > 0").count()
    report = quality.report(whole).head().asDict()
    assert quality.failed(report) == [] and report["n"] == 2000
    r = whole.filter("dist_km < 20").head()
    assert r.m_direct and r.h_w == pytest.approx(0.6 + 0.2 * 12 / 13)
    assert {(x.storm_id, x.reason) for x in snapshot.rejected(tracks).collect()} == {("x", "no wind")}
    near = whole.filter("abs(dist_km - r_direct) < 8").select("wind_kt").collect()
    assert near and all(30 < x.wind_kt < 40 for x in near)  # calibrated: 34 kt at each quadrant's radius


def test_declarations_read(spark):
    rows = [(7, "Hidrometeorológico", 'Ciclón tropical "Odile", lluvia severa', 3008, "E", "14/09/2014", "16/09/2014"), (8, "Hidrometeorológico", "HURACÁN Delta", 23001, "D", "8/10/2020", "7/10/2020"),
            (9, "Geológico", "sismo y huracán", 1, "D", "1/1/2020", None), (10, "Hidrometeorológico", "huracan", 1, "D", "bad", None)]
    df = spark.createDataFrame(rows, "id int, class string, notes string, place_code int, kind string, start string, end string")
    got = {r.id_decl: r for r in tables.declarations(df).collect()}
    assert set(got) == {7, 8} and got[7].place == "03008" and got[7].storm_name == "ODILE" and got[7].mentions_rain and not got[7].inverted
    assert got[8].inverted and got[8].start == dt.datetime(2020, 10, 7) and got[8].end == dt.datetime(2020, 10, 8)
    assert declarations.steps(tables.declarations(df)).filter("id_decl = 7").count() == 12


def test_cloud_texts(spark):
    flat = spark.createDataFrame([("9 8 2013 6 11.0 -116.2 37.0 1008 626.05 542.21 679.67 713.31 640.31 0.24 0.51 0.31 CP032013",), (" ",)], "value string")
    r = tables.cloud_flat(flat).collect()[0]
    assert (r.storm_id, r.time, r.rocloud_rne, r.rocloud_rnw, r.rocloud_rsw, r.rocloud_rse) == ("CP032013", dt.datetime(2013, 8, 9, 6), 626.05, 542.21, 679.67, 713.31)
    line = "20000613 0600 11.0 -100.1 35 1005 100 -9999 0 130 115 .1 .2 .3 1 2 3 4 2.5"
    text = f"EP022000, BUD, 2,\n{line}\n{line}\n\nEP032000, CARL, 2,\n{line}\n"
    got = tables.cloud_blocks(spark.createDataFrame([("f", text)], "path string, value string")).orderBy("storm_id", "record_number").collect()
    assert [(x.storm_id, x.storm_name, x.record_number) for x in got] == [("EP022000", "BUD", 1), ("EP022000", "BUD", 2), ("EP032000", "CARL", 1)]
    assert got[0].rocloud_rnw is None and got[0].rocloud_rse == 130 and got[0].time == dt.datetime(2000, 6, 13, 6)
    blocks = tables.cloud_blocks(spark.createDataFrame([("f", text)], "path string, value string"))
    assert [(x.storm_id, x.declared, x.found) for x in tables.wrong_counts(blocks).collect()] == [("EP032000", 2, 1)]
    for bad, say in ((line, "no header"), ("A, B, 1,\n1 2 3", "19 fields")):
        with pytest.raises(Exception, match=say):
            tables.cloud_blocks(spark.createDataFrame([("f", bad)], "path string, value string")).collect()


def test_tracks(spark):
    raw = spark.createDataFrame([("A", "2020-08-01 00:00:00", "10.5", "-100", "x")], "`Storm-ID` string, ISO_Time string, lat string, lon string, wind string")
    r = tables.tracks(raw, {"storm_id": "Storm-ID", "time": "ISO_Time", "vmax_kt": "wind"}).head()
    assert r.storm_id == "A" and r.lat == 10.5 and r.vmax_kt is None
    with pytest.raises(KeyError):
        tables.tracks(raw)
    cube = spark.createDataFrame([(bytearray(b"2020A "), ["2020-08-01 00:00:00", ""], [10.0, 11.0], [-100.0, float("nan")], [50.0, 1.0], [990.0, 1.0], [20.0, 1.0], [[60.0, 50.0, None, 40.0], None])],
                                 "sid binary, iso_time array<string>, lat array<double>, lon array<double>, usa_wind array<double>, usa_pres array<double>, usa_rmw array<double>, usa_r34 array<array<double>>")
    b = tables.best_tracks(cube).collect()
    assert len(b) == 1 and b[0].storm_id == "2020A" and b[0].rmw_km == pytest.approx(37.04) and b[0].r34_rsw is None and b[0].r34_rnw == 40.0
    assert tables.one_storm(tables.best_tracks(cube), "2020A").count() == 1
    with pytest.raises(Exception, match="no storm"):
        tables.one_storm(tables.best_tracks(cube), "zz").collect()


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(0, T0, 2021, 1.234), (1, T0, 2020, 2.0)], "cell int, time timestamp, season int, p6 double")
    tables.write_seasons(df, str(tmp_path / "rain"))
    tables.write_seasons(df.filter("season = 2020").withColumn("p6", F.lit(9.0)), str(tmp_path / "rain"))
    back = {r.season: r.p6 for r in spark.read.parquet(str(tmp_path / "rain")).collect()}
    assert back == {2020: 9.0, 2021: 1.23}
    tables.write(df, str(tmp_path / "a.csv"), exclude=["time"])
    assert tables.read(spark, str(tmp_path / "a.csv")).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write(df, str(tmp_path / "a.csv"), overwrite=False)
    with pytest.raises(ValueError):
        tables.check_apart("/data/in", "/data/in/out")
    r = tables.rain(spark.createDataFrame([(T0, 10.0, 250.0, -1.0), (T0 + dt.timedelta(hours=1), 1.0, 1.0, 1.0)], "time timestamp, lat double, lon double, precip double")).collect()
    assert len(r) == 1 and r[0].lon == -110.0 and r[0].precipitation is None


def test_sets_and_units(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert sets.stacked({"a": a, "b": a.drop("v")}, "name").count() == 4
    units = quality.with_units(a, {"k": "km"})
    quality.require_units(units, {"k": "km"})
    with pytest.raises(ValueError):
        quality.require_units(units, {"k": "nm"})
    with pytest.raises(KeyError):
        quality.require_columns(a, ["z"])


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("radii: {mode: always}\nwind: {tail_end_ms: 12.0}\n")
    base = config.load(str(tmp_path / "c.yaml"))
    s = config.settings(config.merged(base, {"radii": {"r34_unit": "km"}, "weights": {"alpha": 2.0}}))
    assert (s.mode, s.r34_unit, s.alpha) == ("always", "km", 2.0) and s.tail_end_kt == pytest.approx(23.326, abs=1e-3)
    assert config.settings() == snapshot.Settings()
    with pytest.raises(ValueError):
        config.settings({"wind": {"tail_end_ms": 1, "tail_end_kt": 1}})
    (tmp_path / "e.yaml").write_text("")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "e.yaml"))


def test_stream(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(hours=h), 1.0) for h in (0, 1, 2, 20, 40)]
    spark.createDataFrame(rows, "k string, ts timestamp, p double").write.parquet(str(tmp_path / "in"))
    for name, f in (("acc", stream_rain.accumulate), ("ep", stream_rain.episodes)):
        source = spark.readStream.schema("k string, ts timestamp, p double").parquet(str(tmp_path / "in"))
        q = f(source, "k").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    acc = spark.table("acc").orderBy("time").collect()
    assert [(r.n, r.p6) for r in acc] == [(3, None), (1, None)]
    ep = spark.table("ep").orderBy("start").collect()
    assert [r.n for r in ep] == [3, 1] and all(a.end <= b.start for a, b in pairwise(ep))
