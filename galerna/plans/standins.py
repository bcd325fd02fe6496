"""Stand-ins for climate tables, made of the tables at hand, in Spark and in SQL.

series: rain by cell and 6-h window end, of events. tracks: three storms along the series' times. grid: places of
the cells. declared: declarations of orders. seasons: yearly values by supplier, of lineitem. SQL fragments are CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galerna.functions.time import window_end

#: Users whose events are one cell's rain, by 6-h steps and by hours: the number of cells grows with the table.
CELL_USERS, HOURLY_USERS = 8, 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(c: str):
    """Sum in decimals, of the same digits in any order of the rows, so that equal sums are equal."""
    return F.sum(F.col(c).cast("decimal(28,10)")).cast("double")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.expr(f"user_id div {HOURLY_USERS}").alias("cell"), F.date_trunc("hour", "ts").alias("time")).agg(exact_sum("value").alias("p"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, time, p6): 6-h sums of what events there are; steps without any are gaps."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.expr(f"user_id div {CELL_USERS}").alias("cell"), window_end(F.col("ts"), label_is="end").alias("time")).agg(exact_sum("value").alias("p6"))


def series_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series`` whose sums of doubles go by the rows of the table, of which event_id is the number, as a scan of it adds them.

    So the SQL has them: two sums of one amount in decimals may differ in their last bit. For what compares sums with each other,
    or with a bound. A running sum, so that no group is gathered.
    """
    e = table(spark, sf_dir, "events")
    rows = e.select(F.expr(f"user_id div {CELL_USERS}").alias("cell"), window_end(F.col("ts"), label_is="end").alias("time"), "event_id", "ts", "value")
    w = Window.partitionBy("cell", "time").orderBy("event_id", "ts", "value")
    so_far = F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.select("cell", "time", so_far.alias("sum"), F.row_number().over(w).alias("row"))
    return ranked.groupBy("cell", "time").agg(F.max_by("sum", "row").alias("p6"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select(F.expr(f"user_id div {CELL_USERS}").alias("cell")).distinct()
    return c.select("cell", (12.0 + 2.0 * (F.col("cell") % 5)).alias("cell_lat"), (-118.0 + 3.0 * F.floor(F.col("cell") / 5)).alias("cell_lon"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = table(spark, sf_dir, "events").select(window_end(F.col("ts"), label_is="end").alias("time")).distinct()
    first = F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    k, i = F.col("k"), F.col("i")
    return times.withColumn("i", ((F.unix_timestamp("time") - first) / 21600).cast("int")).withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).select(
        F.concat(F.lit("S"), k.cast("string")).alias("storm_id"), "time", "i", "k",
        (11.0 + 2.0 * k + 0.07 * i).alias("lat"), (-119.0 + 4.0 * k + 0.05 * i).alias("lon"),
        (25.0 + 10.0 * ((i + k) % 12)).alias("vmax_kt"), F.when((i + k) % 7 != 0, 20.0 + 5.0 * (i % 5)).alias("rmw_km"),
        *(F.when((i + k + j) % 4 != 0, 60.0 + 10.0 * j + 2.0 * (i % 10)).alias(f"r34_{q}") for j, q in enumerate(("rne", "rse", "rsw", "rnw"))),
        *(F.when((i + j) % 3 != 0, 300.0 + 40.0 * ((i + j) % 9)).otherwise(0.0).alias(f"rocloud_{q}") for j, q in enumerate(("rne", "rse", "rsw", "rnw"))),
    )


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place, cell, n_centres): every cell in one place of five; places 3 and 4 have their cells as nearest ones."""
    c = grid(spark, sf_dir)
    place = F.col("cell") % 6
    return c.select(place.alias("place"), "cell", F.when(place < 4, F.lit(1)).otherwise(F.lit(0)).alias("n_centres"))


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_decl, place, kind, start, end): of each order; the dates of some are inverted."""
    o = table(spark, sf_dir, "orders")
    day = F.expr("timestamp '2024-01-01 00:00:00'") + F.make_dt_interval((F.col("o_orderkey") % 25).cast("int"))
    shift = F.make_dt_interval((F.col("o_custkey") % 4 - 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id_decl"), (F.col("o_custkey") % 6).alias("place"), F.when(F.col("o_orderkey") % 3 == 0, "D").otherwise("E").alias("kind"),
        day.alias("start"), F.when(F.col("o_orderkey") % 7 != 0, day + shift).alias("end"),
    )


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, season, time, r): shipped quantities by supplier, month and year."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("cell"), (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).alias("season"), F.col("l_shipdate").alias("time"),
                     F.col("l_orderkey"), F.col("l_linenumber"), F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice") / 1000).alias("r"))


def epoch(c: str = "time", name: str = "t"):
    return F.unix_timestamp(c).alias(name)


_END = "make_timestamp((ceil(epoch({0}) / 21600) * 21600 * 1000000)::BIGINT)"

SQL = {
    "hourly": f"hourly AS (SELECT user_id // {HOURLY_USERS} AS cell, date_trunc('hour', ts) AS time, sum(value) AS p FROM events GROUP BY 1, 2)",
    "series": f"series AS (SELECT user_id // {CELL_USERS} AS cell, {_END.format('ts')} AS time, sum(value) AS p6 FROM events GROUP BY 1, 2)",
    "grid": f"grid AS (SELECT cell, 12.0 + 2.0 * (cell % 5) AS cell_lat, -118.0 + 3.0 * (cell // 5) AS cell_lon FROM (SELECT DISTINCT user_id // {CELL_USERS} AS cell FROM events))",
    "tracks": f"""steps AS (SELECT DISTINCT {_END.format('ts')} AS time FROM events),
      tracks AS (SELECT 'S' || k AS storm_id, time, i, k, (11.0 + 2.0 * k + 0.07 * i)::DOUBLE AS lat, (-119.0 + 4.0 * k + 0.05 * i)::DOUBLE AS lon, (25.0 + 10.0 * ((i + k) % 12))::DOUBLE AS vmax_kt,
        CASE WHEN (i + k) % 7 <> 0 THEN 20.0 + 5.0 * (i % 5) END::DOUBLE AS rmw_km,
        """
    + ", ".join(f"CASE WHEN (i + k + {j}) % 4 <> 0 THEN 60.0 + 10.0 * {j} + 2.0 * (i % 10) END::DOUBLE AS r34_{q}" for j, q in enumerate(("rne", "rse", "rsw", "rnw")))
    + ", "
    + ", ".join(f"CASE WHEN (i + {j}) % 3 <> 0 THEN 300.0 + 40.0 * ((i + {j}) % 9) ELSE 0 END::DOUBLE AS rocloud_{q}" for j, q in enumerate(("rne", "rse", "rsw", "rnw")))
    + """ FROM (SELECT time, ((epoch(time) - epoch(TIMESTAMP '2024-01-01')) / 21600)::INT AS i FROM steps), (SELECT unnest([0, 1, 2]) AS k))""",
    "bridge": f"bridge AS (SELECT cell % 6 AS place, cell, CASE WHEN cell % 6 < 4 THEN 1 ELSE 0 END AS n_centres FROM (SELECT DISTINCT user_id // {CELL_USERS} AS cell FROM events))",
    "declared": """declared AS (SELECT o_orderkey AS id_decl, o_custkey % 6 AS place, CASE WHEN o_orderkey % 3 = 0 THEN 'D' ELSE 'E' END AS kind,
        TIMESTAMP '2024-01-01' + to_days((o_orderkey % 25)::INT) AS "start",
        CASE WHEN o_orderkey % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((o_orderkey % 25)::INT) + to_days((o_custkey % 4 - 1)::INT) END AS "end"
        FROM orders),
      dated AS (SELECT id_decl, place, kind, least("start", coalesce("end", "start")) AS "start", greatest("start", coalesce("end", "start")) AS "end", coalesce("start" > "end", false) AS inverted FROM declared)""",
    "seasons": "seasons AS (SELECT l_suppkey AS cell, year(l_shipdate) * 4 + quarter(l_shipdate) AS season, l_shipdate AS time, l_orderkey, l_linenumber, CASE WHEN l_linenumber < 7 THEN l_extendedprice / 1000 END AS r FROM lineitem)",
    "rolled": """rolled AS (SELECT cell, time, p6,
        CASE WHEN count(p6) OVER d24 = 4 THEN sum(p6) OVER d24 END AS r24, CASE WHEN count(p6) OVER d72 = 12 THEN sum(p6) OVER d72 END AS r72,
        CASE WHEN count(p6) OVER b72 = 12 THEN sum(p6) OVER b72 END AS a72 FROM series
      WINDOW d24 AS (PARTITION BY cell ORDER BY time RANGE BETWEEN INTERVAL 18 HOURS PRECEDING AND CURRENT ROW),
        d72 AS (PARTITION BY cell ORDER BY time RANGE BETWEEN INTERVAL 66 HOURS PRECEDING AND CURRENT ROW),
        b72 AS (PARTITION BY cell ORDER BY time RANGE BETWEEN INTERVAL 72 HOURS PRECEDING AND INTERVAL 6 HOURS PRECEDING))""",
    "peaks": """peaks AS (SELECT cell, time, p6 FROM (SELECT cell, time, p6,
        max(p6) OVER (PARTITION BY cell ORDER BY time RANGE BETWEEN INTERVAL 48 HOURS PRECEDING AND INTERVAL 1 SECOND PRECEDING) AS b,
        max(p6) OVER (PARTITION BY cell ORDER BY time RANGE BETWEEN INTERVAL 1 SECOND FOLLOWING AND INTERVAL 48 HOURS FOLLOWING) AS a FROM series)
      WHERE p6 >= 1 AND p6 > coalesce(b, -1e300) AND p6 >= coalesce(a, -1e300))""",
    "maxima": "maxima AS (SELECT cell, season, CASE WHEN count(r) >= 0.8 * count(*) THEN max(r) END AS maximum, count(r) AS n_valid, count(*) AS n_rows FROM seasons GROUP BY 1, 2)",
    "top": "top AS (SELECT cell, r, rank FROM (SELECT cell, r, row_number() OVER (PARTITION BY cell ORDER BY r DESC, l_orderkey, l_linenumber) AS rank FROM seasons WHERE r IS NOT NULL) WHERE rank <= 31)",
    "n_seasons": "n_seasons AS (SELECT cell, count(*) AS n_seasons FROM maxima WHERE maximum IS NOT NULL GROUP BY 1)",
    "moments": """moments AS (SELECT cell, count(*) AS n, avg(x) AS b0, sum(x * (i - 1)) / (count(*) * (count(*) - 1)) AS b1, sum(x * (i - 1) * (i - 2)) / (count(*) * (count(*) - 1) * (count(*) - 2)) AS b2
        FROM (SELECT cell, maximum AS x, row_number() OVER (PARTITION BY cell ORDER BY maximum)::DOUBLE AS i FROM maxima WHERE maximum IS NOT NULL) GROUP BY 1),
      lm AS (SELECT cell, n, b0 AS l1, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3 FROM moments)""",
    "gev": """shape AS (SELECT *, 2 / (3 + l3 / l2) - ln(2) / ln(3) AS c FROM lm),
      kk AS (SELECT *, 7.8590 * c + 2.9554 * c * c AS raw, least(greatest(7.8590 * c + 2.9554 * c * c, -0.5), 0.5) AS k FROM shape),
      gev AS (SELECT cell, n, -k AS xi, l2 * k / ((1 - pow(2, -k)) * gamma(1 + k)) AS sigma, l1 - l2 * k / ((1 - pow(2, -k)) * gamma(1 + k)) * (1 - gamma(1 + k)) / k AS mu, k <> raw AS clipped FROM kk WHERE n >= 15)""",
    "gpd": """ends AS (SELECT cell, max(rank) AS last, min(r) AS u FROM top GROUP BY 1),
      excess AS (SELECT top.cell, r - u AS x, row_number() OVER (PARTITION BY top.cell ORDER BY r - u)::DOUBLE AS i FROM top JOIN ends ON top.cell = ends.cell WHERE rank < last),
      em AS (SELECT cell, count(*) AS n, avg(x) AS l1, 2 * sum(x * (i - 1)) / (count(*) * (count(*) - 1)) - avg(x) AS l2 FROM excess GROUP BY 1),
      ek AS (SELECT em.*, u, n_seasons, l1 / l2 - 2 AS raw, least(greatest(l1 / l2 - 2, -0.5), 0.5) AS k FROM em JOIN ends USING (cell) JOIN n_seasons USING (cell)),
      gpd AS (SELECT cell, u, -k AS xi, (1 + k) * l1 AS sigma, n / n_seasons AS rate, k <> raw AS clipped, n AS n_excess, n_seasons FROM ek WHERE n >= 20)""",
    "q": """q AS (SELECT cell, quantile_cont(p6, 0.75) AS q75, quantile_cont(p6, 0.9) AS q90, quantile_cont(p6, 0.95) AS q95 FROM series GROUP BY 1)""",
}


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
