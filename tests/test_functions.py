"""Scalar functions against plain Python and hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from galerna import constants as C
from galerna.functions import basic, extremes, geometry, hazard, radii, text, wind
from galerna.functions import time as tm


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return tuple(df.select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).head())


def column(spark, values, f, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select(f(F.col("x")).alias("y"), "i").orderBy("i").collect()]


# a reference wind profile in plain Python


def ramp(x):
    x = min(max(x, 0.0), 1.0)
    return x**5 * (126 - 420 * x + 540 * x**2 - 315 * x**3 + 70 * x**4)


class Profile:
    def __init__(self, v, lat, rmax=None, x1=None, variant="w06"):
        a, b, c = wind.RMAX[variant]
        self.v, self.rmax = v, rmax or a * math.exp(b * v + c * abs(lat))
        self.n, self.a = 0.4067 + 0.0144 * v - 0.0038 * abs(lat), max(0.0696 + 0.0049 * v - 0.0064 * abs(lat), 0)
        self.x1 = x1 or 317.1 - 2.026 * v + 1.915 * abs(lat)
        self.width = 25.0 if self.rmax > 20 else 15.0
        w = self.n / (self.n + self.rmax * ((1 - self.a) / self.x1 + self.a / 25))
        low, high = 0.0, 1.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if w - ramp(mid) > 0 else (low, mid)
        self.r1 = max(self.rmax - (low + high) / 2 * self.width, 0)

    def __call__(self, r):
        d = r - self.rmax
        outer = self.v * ((1 - self.a) * math.exp(-d / self.x1) + self.a * math.exp(-d / 25))
        w = ramp((r - self.r1) / self.width)
        return self.v * (r / self.rmax) ** self.n * (1 - w) + outer * w


def root(f, low, high, n=60):
    for _ in range(n):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return (low + high) / 2


@pytest.mark.parametrize("v, lat, rmw", [(20.0, 15.0, None), (45.0, 22.0, 30.0), (70.0, -18.0, 12.0)])
def test_profile(spark, v, lat, rmw):
    p = Profile(v, lat, rmw)
    got = spark.range(1).select(wind.profile(F.lit(v), F.lit(lat), F.lit(rmw).cast("double")).alias("p"))
    values = got.select("p.rmax", "p.r1", *(wind.wind_ms(F.col("p"), float(r)).alias(f"v{r}") for r in (1, 10, 40, 200, 900)), wind.radius_of_wind(F.col("p"), 17.0).alias("r")).head()
    assert values.rmax == pytest.approx(p.rmax) and values.r1 == pytest.approx(p.r1, abs=1e-9)
    assert [values[f"v{r}"] for r in (1, 10, 40, 200, 900)] == pytest.approx([p(r) for r in (1, 10, 40, 200, 900)])
    assert values.r == pytest.approx(root(lambda r: p(r) - 17.0, p.rmax, 5000.0))


def test_published_outer_radii(spark):
    for kt, lat, want in ((135.0, 22.1, 745), (97.19, 22.0, 812)):
        (r,) = one(spark, wind.reference_radii(F.lit(kt), F.lit(lat))["r_outer_km"])
        assert abs(r / want - 1) < 0.05


def test_calibration_round_trip(spark):
    storm = wind.calibrated_storm(F.lit(100.0), F.lit(20.0), F.lit(30.0), F.lit(180.0))
    s = spark.range(1).select(storm.alias("s"))
    v, r34 = s.select(wind.wind_ms(F.col("s.profile"), 180.0), "s.r34_mean_km").head()
    assert v == pytest.approx(C.R34_MS, abs=1e-6) and r34 == 180.0
    weak = spark.range(1).select(wind.calibrated_storm(F.lit(30.0), F.lit(20.0), F.lit(None).cast("double"), F.lit(180.0)).alias("s"))
    assert weak.select("s.r34_mean_km").head()[0] is None
    direct, eye = s.select(
        wind.hazard_with_tail(F.lit(100.0), F.lit(100.0), F.lit(700.0), F.col("s"))["wind_kt"].alias("a"), wind.hazard_with_tail(F.lit(1.0), F.lit(180.0), F.lit(700.0), F.col("s"))["h_w"].alias("b")
    ).head()
    assert direct == pytest.approx(34.0, abs=1e-5) and eye == pytest.approx(0.8 + 0.2 * 4 / 41)


def test_wind_nodes(spark):
    got = column(spark, [34.0, 49.0, 64.0, 83.0, 96.0, 137.0, 185.0, 23.0, 28.5], lambda x: wind.wind_hazard(x, F.lit(23.0)))
    assert got == pytest.approx([0.2, 0.3, 0.4, 0.6, 0.8, 1.0, 1.0, 0.0, 0.1])


def test_rain_ramps(spark):
    q = {"Q75": F.lit(8.0), "Q90": F.lit(18.0), "Q95": F.lit(28.0)}
    long = {"r24": {"Q90": F.lit(40.0), "Q95": F.lit(55.0)}, "a72": {"Q75": F.lit(30.0)}}
    h = lambda p, r, a, combine="all": hazard.RainMatrix(combine=combine).hazard(p, q, {"r24": F.lit(r), "a72": F.lit(a)}, long)
    rain = [0.0, 4.0, 8.0, 13.0, 18.0, 23.0, 28.0, 39.0, 50.0, 80.0]
    assert column(spark, rain, lambda p: h(p, 0.0, 0.0)) == pytest.approx([0, 0, 0, 0.125, 0.25, 0.625, 1, 1, 1, 1])
    assert column(spark, [0.0, 8.0, 18.0, 28.0, 50.0], lambda p: h(p, 60.0, 30.0)) == pytest.approx([0, 0, 0.8, 1, 1])
    for combine, f in (("all", 0.25), ("any", 0.5)):
        assert column(spark, [18.0], lambda p: h(p, 47.5, 15.0, combine)) == pytest.approx([0.25 + f * 0.55])  # noqa: B023
    assert column(spark, [-1.0, None], lambda p: hazard.rain_ramp(p, q, ("Q75",), (0.1, 0.5))) == [pytest.approx(0.1), None]
    with pytest.raises(ValueError):
        hazard.rain_ramp(F.lit(1.0), q, ("Q75",), (0.5, 0.1))


def test_components(spark):
    m = {"m_direct": F.col("d"), "m_indirect": F.col("i"), "m_exterior": ~F.col("d") & ~F.col("i")}
    df = spark.createDataFrame([(True, False), (False, True), (False, False)], "d boolean, i boolean")
    out = [r[0] for r in df.select(hazard.components(F.lit(0.5), F.lit(0.4), m)["h_total"]).collect()]
    assert out == pytest.approx([0.7, 0.7, 0.0])
    with pytest.raises(ValueError):
        hazard.combined(F.lit(0.1), F.lit(0.2), -1.0)


def test_radii(spark):
    cloud = geometry.radii(ne=800.0, rse=None, SW=300.0, rno=0.0)
    direct = geometry.uniform(100.0)
    floor = spark.range(1).select(radii.attribution_radius(cloud, geometry.uniform(700.0), direct).alias("a")).select("a.radii.*", "a.status.*").head()
    assert tuple(floor) == (800, 700, 700, 700, "cloud", "reference", "floor", "reference")
    never = spark.range(1).select(radii.attribution_radius(geometry.radii(rne=800.0, rse=None, rsw=300.0, rnw=500.0), geometry.uniform(700.0), direct, "never").alias("a")).select("a.radii.rse").head()
    assert never[0] == pytest.approx(533.3333333)
    none = geometry.radii(rne=None, rse=None, rsw=None, rnw=None)
    kinds = spark.range(1).select(*(radii.direct_radius(*x)["source"].alias(f"c{k}") for k, x in enumerate([
        (none, F.lit(30.0), F.lit(25.0), F.lit(80.0)), (none, F.lit(90.0), F.lit(25.0), F.lit(80.0)), (geometry.radii(rne=1.0, rse=0.0, rsw=None, rnw=2.0), F.lit(90.0), F.lit(None).cast("double"), F.lit(80.0)),
    ]))).head()
    assert tuple(kinds) == ("rmw", "fallback", "r34_filled")
    with pytest.raises(KeyError):
        geometry.radii(ne=1.0)
    with pytest.raises(ValueError):
        radii.attribution_radius(cloud, direct, direct, "other")


def test_classes_and_levels(spark):
    assert column(spark, [None, -1.0, 0.0, 1e-9, 0.2, 0.200001, 0.8, 1.0, 2.0], basic.hazard_class) == [None, 0, 0, 1, 1, 2, 4, 5, 5]
    q = [(75, F.lit(8.0)), (90, F.lit(18.0)), (95, F.lit(28.0)), (99, F.lit(50.0))]
    assert column(spark, [1.0, 10.0, 30.0, 60.0], lambda x: basic.percentile_level(x, q)) == [0, 75, 95, 99]
    assert basic.percentile_labels((0.75, 0.999)) == ["P75", "P99_9"] and basic.quantile_name(0.999) == "Q99.9"
    assert basic.level_names(["P75", "P90"]) == ["<P75", "P75-P90", ">=P90"]


def test_extreme_values(spark):
    assert column(spark, [0.5, 0.9, 1.0, 1.25, 1.5], extremes.gamma) == pytest.approx([math.gamma(x) for x in (0.5, 0.9, 1.0, 1.25, 1.5)])
    for xi in (-0.15, 0.0, 0.15):
        p = (F.lit(xi), F.lit(20.0), F.lit(80.0))
        back = column(spark, [2.0, 10.0, 100.0], lambda t: extremes.gev_period(extremes.gev_level(t, *p), *p))  # noqa: B023
        assert back == pytest.approx([2.0, 10.0, 100.0])
        level = lambda r: extremes.pot_level(r, F.lit(30.0), F.lit(12.0), F.lit(xi), F.lit(3.0))  # noqa: B023, E731
        again = column(spark, [0.5, 5.0, 50.0], lambda r: extremes.pot_interval(level(r), F.lit(30.0), F.lit(12.0), F.lit(xi), F.lit(3.0)))  # noqa: B023
        assert again == pytest.approx([0.5, 5.0, 50.0])
    assert column(spark, [0.2], lambda r: extremes.pot_level(r, F.lit(30.0), F.lit(12.0), F.lit(0.1), F.lit(3.0))) == [None]
    assert column(spark, [5.0], lambda t: extremes.annual_period(extremes.recurrence(t))) == pytest.approx([5.0])
    with pytest.raises(ValueError):
        extremes.gev_level(1.0, F.lit(0.1), F.lit(1.0), F.lit(0.0))


def test_geometry(spark):
    d = geometry.distance_km(20.0, 179.5, 20.0, -179.5)
    quads = [geometry.quadrant(F.lit(a), F.lit(b), F.lit(20.0), F.lit(-100.0)) for a, b in ((20.0, -100.0), (21.0, -101.0), (19.0, -99.0), (19.0, -101.0))]
    got = one(spark, d, *quads, geometry.longitude_difference(F.lit(-190.0)), geometry.bearing_deg(0.0, 0.0, 1.0, 0.0), geometry.bearing_deg(0.0, 0.0, 0.0, -1.0))
    assert got[0] == pytest.approx(104.49, abs=0.1) and got[1:5] == ("rne", "rnw", "rse", "rsw") and got[5:] == pytest.approx((170.0, 0.0, 270.0))
    with pytest.raises(ValueError):
        geometry.km_in("furlong")


def test_times(spark):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    at = lambda t: F.lit(t).cast("timestamp")
    got = one(
        spark, stamp(tm.window_end(at("2024-01-01 05:00:00"))), stamp(tm.window_end(at("2024-01-01 06:00:00"))), stamp(tm.window_end(at("2024-01-01 06:00:00"), label_is="end")),
        stamp(tm.time_from_name(F.lit("rain.2020031.06.nc"))), stamp(tm.time_from_name(F.lit("x_20201231-18.nc4"))), tm.time_from_name(F.lit("notes.txt")), F.size(tm.season_window_ends(F.lit(2020))),
        stamp(tm.nearest_hour(at("2024-01-01 05:59:00"))), tm.normalized_hour(F.lit(600)), tm.normalized_hour(F.lit(6)), stamp(tm.to_utc(at("2024-01-01 00:00:00"), -6)),
        F.size(tm.six_hour_steps(at("2024-01-01 00:00:00"), at("2024-01-02 00:00:00"), 1, 1)),
    )
    assert got == ("2024-01-01 06:00", "2024-01-01 12:00", "2024-01-01 06:00", "2020-01-31 06:00", "2020-12-31 18:00", None, 856, "2024-01-01 06:00", 6, 6, "2024-01-01 06:00", 16)
    with pytest.raises(Exception, match="not an hour"):
        one(spark, tm.normalized_hour(F.lit(650)))


def test_texts(spark):
    words = ["México", "MichoacÃ¡n", "  San José-del  Cabo ", "plain", None]
    assert column(spark, words, text.comparable, "string") == ["mexico", "michoacan", "san jose del cabo", "plain", None]
    assert column(spark, ['Huracán "Odile" pasó', "sin nombre"], text.quoted_name, "string") == ["ODILE", None]
    assert column(spark, ["Ciclón tropical", "sismo", None], lambda x: text.any_of(x, ("ciclon tropical", "huracan")), "string") == [True, False, False]
    assert text.column_name(" Fecha  Inicio/UTC-6 ") == "fecha_inicio_utc_6"
