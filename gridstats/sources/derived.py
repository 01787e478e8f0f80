"""Grid tables derived from the test tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = ("scenario", "member")
CELL = ("lat", "lon")
FIELDS = ("tas", "tasmax", "tasmin", "prec", "sphum", "weight")

OBS_SQL = """
    SELECT 'rcp_' || lower(l_returnflag) AS scenario, CAST(l_suppkey % 4 AS INT) AS member, CAST(l_shipdate AS DATE) AS time,
           CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
           CAST(-30 + 5 * (l_partkey % 5) AS DOUBLE) AS lat, CAST(290 + 5 * (floor(l_partkey / 5) % 5) AS DOUBLE) AS lon,
           285 + l_quantity * 0.3 AS tas, 288 + l_quantity * 0.3 + l_discount * 50 AS tasmax,
           282 + l_quantity * 0.3 - l_tax * 50 AS tasmin, l_discount * 100 AS prec, 0.005 + l_tax / 20 AS sphum,
           l_extendedprice AS weight, CAST(l_linenumber AS INT) AS pft, l_quantity AS pct
    FROM lineitem"""

_MEANS = ", ".join(f"avg({f}) AS {f}" for f in FIELDS)
MONTHLY_SQL = f"SELECT scenario, member, year, month, lat, lon, {_MEANS} FROM ({OBS_SQL}) GROUP BY scenario, member, year, month, lat, lon"
YEARLY_SQL = f"SELECT scenario, member, year, lat, lon, {_MEANS} FROM ({OBS_SQL}) GROUP BY scenario, member, year, lat, lon"
CLIM_SQL = "SELECT scenario, member, month, lat, lon, avg(tas) AS tas, var_samp(tas) AS tas_var, avg(prec) AS prec, var_samp(prec) AS prec_var, count(*) AS n FROM ({}) GROUP BY scenario, member, month, lat, lon".format(MONTHLY_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point values: 3 scenarios x 4 members x 25 cells by day."""
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("rcp_"), F.lower("l_returnflag")).alias("scenario"), (F.col("l_suppkey") % 4).cast("int").alias("member"),
        F.col("l_shipdate").cast("date").alias("time"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
        (-30 + 5 * (F.col("l_partkey") % 5)).cast("double").alias("lat"), (290 + 5 * (F.floor(F.col("l_partkey") / 5) % 5)).cast("double").alias("lon"),
        (285 + q * 0.3).alias("tas"), (288 + q * 0.3 + d * 50).alias("tasmax"), (282 + q * 0.3 - t * 50).alias("tasmin"),
        (d * 100).alias("prec"), (0.005 + t / 20).alias("sphum"), F.col("l_extendedprice").alias("weight"),
        F.col("l_linenumber").cast("int").alias("pft"), q.alias("pct"),
    )


def _means(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(f).alias(f) for f in FIELDS])


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(obs(spark, sf_dir), *RUN, "year", "month", *CELL)


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(obs(spark, sf_dir), *RUN, "year", *CELL)


#: Daily rain and temperature by scenario: every day of the span, rain gaps 0, temperature gaps carried forward.
DAILY_SQL = f"""
    SELECT s.scenario, s.time, coalesce(o.prec, 0.0) AS prec,
           last_value(o.tmin IGNORE NULLS) OVER w AS tmin, last_value(o.tmax IGNORE NULLS) OVER w AS tmax
    FROM (SELECT scenario, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS time
          FROM (SELECT scenario, DATE '1995-01-01' AS a, max(time) AS b FROM ({OBS_SQL}) GROUP BY scenario)) s
    LEFT JOIN (SELECT scenario, time, avg(prec) / 2 AS prec, avg(tasmin) - 273.15 AS tmin, avg(tasmax) - 273.15 AS tmax
               FROM ({OBS_SQL}) GROUP BY scenario, time) o ON s.scenario = o.scenario AND s.time = o.time
    WINDOW w AS (PARTITION BY s.scenario ORDER BY s.time)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = obs(spark, sf_dir)
    span = o.groupBy("scenario").agg(F.max("time").alias("last"))
    spine = span.select("scenario", F.explode(F.sequence(F.to_date(F.lit("1995-01-01")), "last")).alias("time"))
    have = o.groupBy("scenario", "time").agg(
        (F.avg("prec") / 2).alias("prec"), (F.avg("tasmin") - 273.15).alias("tmin"), (F.avg("tasmax") - 273.15).alias("tmax")
    )
    w = Window.partitionBy("scenario").orderBy("time")
    return spine.join(have, ["scenario", "time"], "left").select(
        "scenario", "time", F.coalesce("prec", F.lit(0.0)).alias("prec"),
        F.last("tmin", ignorenulls=True).over(w).alias("tmin"), F.last("tmax", ignorenulls=True).over(w).alias("tmax"),
    )


#: Daily rain of every cell of every member from 1995 to its last day with any; days without are 0.
SERIES = ("scenario", "member", "lat", "lon")
CELL_DAYS_SQL = f"""
    SELECT s.scenario, s.member, s.lat, s.lon, s.time, coalesce(o.prec, 0.0) AS prec
    FROM (SELECT scenario, member, lat, lon, CAST(unnest(generate_series(DATE '1995-01-01', max(time), INTERVAL 1 DAY)) AS DATE) AS time FROM ({OBS_SQL}) GROUP BY scenario, member, lat, lon) s
    LEFT JOIN (SELECT scenario, member, lat, lon, time, sum(prec) * 6 AS prec FROM ({OBS_SQL}) GROUP BY scenario, member, lat, lon, time) o USING (scenario, member, lat, lon, time)"""


def cell_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with rain alone; fill_days adds the others."""
    return obs(spark, sf_dir).groupBy(*SERIES, "time").agg((F.sum("prec") * 6).alias("prec"))


#: Zone codes and names of cells, as a dimension table.
ZONES_SQL = """SELECT DISTINCT CAST(-30 + 5 * (l_partkey % 5) AS DOUBLE) AS lat, CAST(290 + 5 * (floor(l_partkey / 5) % 5) AS DOUBLE) AS lon,
    CAST(1 + (l_partkey % 5) % 3 AS INT) AS code FROM lineitem"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).select("lat", "lon").distinct()
    return o.withColumn("code", (1 + ((F.col("lat") + 30) / 5).cast("int") % 3).cast("int"))


def zone_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("code"), F.col("r_name").alias("name"))


ZONE_NAMES_SQL = "SELECT CAST(r_regionkey AS INT) AS code, r_name AS name FROM region"
