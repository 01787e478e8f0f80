"""Windows, ordered operators, sorts and set operations (E, F, G)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridstats.functions import scalar as S
from gridstats.operators import project as P
from gridstats.operators import season as SE
from gridstats.operators import timegrid as TG
from gridstats.operators import vertical as V
from gridstats.plans.registry import query
from gridstats.sources.derived import CELL_DAYS_SQL, MONTHLY_SQL, OBS_SQL, YEARLY_SQL, cell_days, monthly, obs, table, yearly

K = ["scenario", "member", "lat", "lon"]
_K = ", ".join(K)
AG_SQL = f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {_K}, ag_year) AS cnt FROM
    (SELECT *, CAST(date_diff('day', make_date(ag_year, 7, 1), time) AS INT) AS ag_day FROM (SELECT *, CAST(year(time) - CASE WHEN month(time) < 7 THEN 1 ELSE 0 END AS INT) AS ag_year FROM ({CELL_DAYS_SQL}))))
    WHERE cnt = date_diff('day', make_date(ag_year, 7, 1), make_date(ag_year + 1, 7, 1))"""


def ag_days(s, d):
    """Daily rain by cell and member, in complete agricultural years."""
    return SE.complete_ag_years(SE.fill_days(cell_days(s, d), K, {"prec": 0.0}, date(1995, 1, 1)), K)


@query("e1_ag_year", f"SELECT {_K}, ag_year, min(time) AS first_day, max(ag_day) AS last_day, count(*) AS days, sum(prec) AS prec FROM ({AG_SQL}) GROUP BY ALL", "prec")
def _(s, d):
    return ag_days(s, d).groupBy(*K, "ag_year").agg(
        F.min("time").alias("first_day"), F.max("ag_day").alias("last_day"), F.count("*").alias("days"), F.sum("prec").alias("prec"))


def _aa_sql(base: float) -> str:
    return f"""SELECT *, aa - lag(aa) OVER w AS daa FROM (SELECT {_K}, ag_year, ag_day, x, sum(x) OVER (PARTITION BY {_K}, ag_year ORDER BY ag_day) AS aa
        FROM (SELECT *, CAST(round(prec * 1000000) AS BIGINT) - {round(base * 1_000_000)} AS x FROM ({AG_SQL}))) WINDOW w AS (PARTITION BY {_K}, ag_year ORDER BY ag_day)"""


@query("e2_anomalous_accumulation", f"""SELECT {_K}, ag_year, count(*) AS days, CAST(min(aa) AS DOUBLE) / 1000000 AS low, CAST(max(aa) AS DOUBLE) / 1000000 AS high, CAST(sum(CASE WHEN ag_day % 7 = 0 THEN aa ELSE 0 END) AS DOUBLE) / 1000000 AS weekly, CAST(sum(daa) AS DOUBLE) / 1000000 AS risen
    FROM ({_aa_sql(2.5)}) GROUP BY ALL""", "low high weekly risen", 5)
def _(s, d):
    # Every day's value enters the year's extremes and sums.
    days = SE.anomalous_accumulation(ag_days(s, d), K)
    return days.groupBy(*K, "ag_year").agg(
        F.count("*").alias("days"), F.min("aa").alias("low"), F.max("aa").alias("high"),
        F.sum(F.when(F.col("ag_day") % 7 == 0, F.col("aa")).otherwise(0.0)).alias("weekly"), F.sum("daa").alias("risen"))


STEEP_SQL = f"SELECT {_K}, ag_year, min(ag_day) AS steepest FROM (SELECT *, max(daa) OVER (PARTITION BY {_K}, ag_year) AS top FROM ({_aa_sql(2.5)})) WHERE daa = top GROUP BY ALL"


@query("e3_steepest_day", STEEP_SQL)
def _(s, d):
    return SE.steepest_day(SE.anomalous_accumulation(ag_days(s, d), K), K)


def rainy_sql(base: float) -> str:
    """Day by day as stated: extremes from day 0 on, days of the extremes looked for in the whole year."""
    return f"""WITH a AS MATERIALIZED ({_aa_sql(base)}),
    top AS (SELECT {_K}, ag_year, max(daa) AS top, sum(x) >= 0 AS wet, max(aa) FILTER (ag_day = 0) AS a0, min(aa) AS least_aa, max(aa) AS most_aa FROM a GROUP BY ALL),
    peak AS (SELECT {_K}, ag_year, min(ag_day) AS peak FROM a JOIN top USING ({_K}, ag_year) WHERE daa = top GROUP BY ALL),
    side AS (SELECT {_K}, ag_year, min(aa) FILTER (ag_day < peak) AS before, max(aa) FILTER (ag_day > peak) AS after FROM a JOIN peak USING ({_K}, ag_year) GROUP BY ALL),
    ends AS (SELECT {_K}, ag_year, CASE WHEN wet THEN least_aa ELSE least(a0, before) END AS low, CASE WHEN wet THEN most_aa ELSE greatest(a0, after) END AS high FROM top JOIN side USING ({_K}, ag_year))
    SELECT {_K}, ag_year, max(ag_day) FILTER (ag_day >= 1 AND aa = low) AS outoday, max(ag_day) FILTER (ag_day >= 1 AND aa = high) AS outeday,
           max(ag_day) FILTER (ag_day >= 1 AND aa = high) - max(ag_day) FILTER (ag_day >= 1 AND aa = low) AS outslen FROM a JOIN ends USING ({_K}, ag_year) GROUP BY ALL"""


RAINY_SQL = rainy_sql(2.5)


def seasons(s, d):
    return SE.rainy_season(ag_days(s, d), K)


@query("e4_rainy_season", RAINY_SQL)
def _(s, d):
    return seasons(s, d)


@query("e4_rainy_season_dry", rainy_sql(4.0))
def _(s, d):
    # A base above the mean rain of most cells, so that the search before and after the steepest day runs.
    return SE.rainy_season(ag_days(s, d), K, base=4.0)


@query("e4r_rainy_season_units", f"SELECT 'm/s' AS units, * FROM ({RAINY_SQL}) UNION ALL SELECT 'kg m-2 s-1', * FROM ({RAINY_SQL})")
def _(s, d):
    # The same rain as fluxes in either unit, back to mm a day before the season is looked for; units are one more key.
    per_day = {"m/s": 86_400_000.0, "kg m-2 s-1": 86_400.0}
    flux = cell_days(s, d).select("*", F.explode(F.array(*[F.struct(F.lit(u).alias("units"), (F.col("prec") / by).alias("flux")) for u, by in per_day.items()])).alias("_u"))
    rain = flux.select("_u.units", *K, "time", S.precip_mm_day(F.col("_u.flux"), F.col("_u.units")).alias("prec"))
    keys = ["units", *K]
    return SE.rainy_season(SE.complete_ag_years(SE.fill_days(rain, keys, {"prec": 0.0}, date(1995, 1, 1)), keys), keys)


@query("b19_valid_season", f"SELECT {_K}, ag_year, CASE WHEN outslen > 20 THEN outoday END AS outoday FROM ({RAINY_SQL})")
def _(s, d):
    v = seasons(s, d).withColumn("outslen", F.col("outslen") - 20)
    return P.valid_season(v, ["outoday"]).select(*K, "ag_year", "outoday")


_MS = f"SELECT {_K}, make_date(CAST(year AS INT), CAST(month AS INT), 1) + 15 AS time, avg(tas) AS tas FROM ({OBS_SQL}) GROUP BY {_K}, year, month"
PAD_SQL = f"SELECT * FROM ({_MS}) UNION ALL SELECT {_K}, min(time) - 31, arg_min(tas, time) FROM ({_MS}) GROUP BY {_K} UNION ALL SELECT {_K}, max(time) + 31, arg_max(tas, time) FROM ({_MS}) GROUP BY {_K}"


def stamped(df):
    """Monthly means at mid-month."""
    m = df.groupBy(*K, "year", "month").agg(F.avg("tas").alias("tas"))
    return m.select(*K, F.date_add(F.make_date("year", "month", F.lit(1)), 15).alias("time"), "tas")


@query("e6_pad_ends", f"SELECT {_K}, CAST(time AS DATE) AS time, tas FROM ({PAD_SQL})", "tas")
def _(s, d):
    return TG.pad_ends(stamped(obs(s, d)), K)


DAYLIN_SQL = f"""SELECT {_K}, CAST(t0 + CAST(i AS INT) AS DATE) AS time, tas + CASE WHEN i = 0 THEN 0 ELSE (nxt - tas) * i / len END AS tas FROM (SELECT *, unnest(range(coalesce(len, 1))) AS i FROM (
    SELECT {_K}, CAST(time AS DATE) AS t0, tas, lead(tas) OVER w AS nxt, date_diff('day', CAST(time AS DATE), CAST(lead(time) OVER w AS DATE)) AS len FROM ({PAD_SQL}) WINDOW w AS (PARTITION BY {_K} ORDER BY time)))"""


def by_month_sql(days: str) -> str:
    return f"SELECT {_K}, CAST(year(time) AS INT) AS year, CAST(month(time) AS INT) AS month, count(*) AS days, min(tas) AS low, avg(tas) AS tas, max(tas) AS high FROM ({days}) GROUP BY ALL"


def by_month(days):
    """What each month holds of a daily series."""
    return days.groupBy(*K, F.year("time").alias("year"), F.month("time").alias("month")).agg(
        F.count("*").alias("days"), F.min("tas").alias("low"), F.avg("tas").alias("tas"), F.max("tas").alias("high"))


@query("e5_monthly_to_daily", by_month_sql(DAYLIN_SQL), "low tas high")
def _(s, d):
    return by_month(TG.monthly_to_daily(TG.pad_ends(stamped(obs(s, d)), K), K, ["tas"]))


LEVELS = [(1, 0.002, 0.0), (2, 0.05, 0.05), (3, 0.12, 0.18), (4, 0.08, 0.5), (5, 0.02, 0.83), (6, 0.0, 0.99)]
LEVELS_SQL = "(VALUES " + ", ".join(str(x) for x in LEVELS) + ") v(lev_no, hyam, hybm)"
COLUMN_SQL = f"SELECT scenario, month, lat, lon, lev_no, hyam * 100000 + hybm * ps AS p, tas - 40 + 8 * lev_no AS t, ps FROM (SELECT scenario, month, lat, lon, avg(tas) AS tas, 100000 - 100 * (avg(tas) - 285) AS ps FROM ({MONTHLY_SQL}) GROUP BY ALL), {LEVELS_SQL}"


def columns(s, d):
    """Six hybrid levels over the monthly field."""
    m = monthly(s, d).groupBy("scenario", "month", "lat", "lon").agg(F.avg("tas").alias("tas")).withColumn("ps", 100000 - 100 * (F.col("tas") - 285))
    lev = s.createDataFrame(LEVELS, "lev_no int, hyam double, hybm double")
    p = V.hybrid_pressure(F.col("hyam"), F.col("hybm"), F.lit(100000.0), F.col("ps"))
    return m.crossJoin(F.broadcast(lev)).select("scenario", "month", "lat", "lon", "lev_no", p.alias("p"), (F.col("tas") - 40 + 8 * F.col("lev_no")).alias("t"), "ps")


CK = ["scenario", "month", "lat", "lon"]
TARGETS_SQL = "(SELECT unnest([" + ", ".join(f"{t * 100.0}" for t in V.PRESSURES) + "]::DOUBLE[]) AS lev)"


@query("e7_interp_levels", f"""SELECT scenario, month, lat, lon, lev, t0 + (lev - p0) / (p1 - p0) * (t1 - t0) AS t FROM (SELECT scenario, month, lat, lon, lev_no, p AS p0, lead(p) OVER w AS p1, t AS t0, lead(t) OVER w AS t1 FROM ({COLUMN_SQL}) WINDOW w AS (PARTITION BY scenario, month, lat, lon ORDER BY p)), {TARGETS_SQL}
    WHERE p1 IS NOT NULL AND (lev >= p0 OR lev_no = 1) AND (lev < p1 OR lev_no = 5)""", "t")
def _(s, d):
    return V.interp_levels(columns(s, d), CK, "p", "t")


THICK_SQL = f"""SELECT *, least(coalesce((p + lead(p) OVER w) / 2, ps), ps) - greatest(coalesce((p + lag(p) OVER w) / 2, 100), 100) AS raw FROM ({COLUMN_SQL}) WINDOW w AS (PARTITION BY scenario, month, lat, lon ORDER BY p)"""


@query("e8_layer_thickness", f"SELECT scenario, month, lat, lon, lev_no, CASE WHEN raw > 0 THEN raw END AS dp FROM ({THICK_SQL})", "dp", 4)
def _(s, d):
    return V.layer_thickness(columns(s, d), CK, "p", "ps", 100.0).select(*CK, "lev_no", "dp")


FLUX_SQL = f"SELECT scenario, lat, lon, avg(sphum * 1000 * (tas - 290)) AS fx, avg(sphum * 1000 * prec) AS fy FROM ({OBS_SQL}) GROUP BY ALL"


def _hav(lat1, lon1, lat2, lon2):
    return f"(2 * 6371229.0 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


CONV_SQL = f"""SELECT scenario, lat, lon, -((fxe - fxw) / {_hav('lat', 'lw', 'lat', 'le')} + (fyn - fys) / {_hav('ls', 'lon', 'ln_', 'lon')}) AS conv FROM (SELECT *, coalesce(lag(fx) OVER x, fx) AS fxw, coalesce(lead(fx) OVER x, fx) AS fxe, coalesce(lag(lon) OVER x, lon) AS lw, coalesce(lead(lon) OVER x, lon) AS le,
    coalesce(lag(fy) OVER y, fy) AS fys, coalesce(lead(fy) OVER y, fy) AS fyn, coalesce(lag(lat) OVER y, lat) AS ls, coalesce(lead(lat) OVER y, lat) AS ln_ FROM ({FLUX_SQL}) WINDOW x AS (PARTITION BY scenario, lat ORDER BY lon), y AS (PARTITION BY scenario, lon ORDER BY lat))"""


def flux(s, d):
    q = F.col("sphum") * 1000
    return obs(s, d).groupBy("scenario", "lat", "lon").agg(F.avg(q * (F.col("tas") - 290)).alias("fx"), F.avg(q * F.col("prec")).alias("fy"))


@query("e9_convergence", f"SELECT scenario, lat, lon, conv * 1e6 AS conv FROM ({CONV_SQL})", "conv")
def _(s, d):
    return V.convergence(flux(s, d), ["scenario"], "fx", "fy").select("scenario", "lat", "lon", (F.col("conv") * 1e6).alias("conv"))


@query("e10_first_slice", f"SELECT scenario, lat, lon, arg_min(tas, year * 100 + month) AS tas FROM (SELECT scenario, lat, lon, year, month, avg(tas) AS tas FROM ({OBS_SQL}) GROUP BY ALL) GROUP BY ALL", "tas")
def _(s, d):
    m = obs(s, d).groupBy("scenario", "lat", "lon", "year", "month").agg(F.avg("tas").alias("tas"))
    return m.groupBy("scenario", "lat", "lon").agg(F.min_by("tas", F.col("year") * 100 + F.col("month")).alias("tas"))


@query("f1_sort_by", f"SELECT scenario, year, avg(tas) AS tas, row_number() OVER (ORDER BY year, scenario) AS place FROM ({OBS_SQL}) GROUP BY scenario, year", "tas")
def _(s, d):
    y = obs(s, d).groupBy("scenario", "year").agg(F.avg("tas").alias("tas"))
    return P.with_place(y, "year", "scenario").orderBy("year", "scenario")


@query("f2_sort_scenarios", f"SELECT scenario, CASE scenario WHEN 'rcp_r' THEN 1 WHEN 'rcp_n' THEN 2 ELSE 3 END AS ord, year, sum(prec) AS prec FROM ({OBS_SQL}) GROUP BY ALL", "prec")
def _(s, d):
    y = obs(s, d).groupBy("scenario", "year").agg(F.sum("prec").alias("prec"))
    return P.select_scenarios(y, ["rcp_r", "rcp_n", "rcp_a"]).orderBy("ord", "year")


@query("f3_pick_nearest", f"SELECT scenario, lat, avg(tas) AS tas FROM ({OBS_SQL}) WHERE lat = -20 GROUP BY ALL", "tas")
def _(s, d):
    g = obs(s, d).groupBy("scenario", "lat").agg(F.avg("tas").alias("tas"))
    near = Window.partitionBy("scenario").orderBy(F.abs(F.col("lat") + 18.3), "lat")
    return g.withColumn("r", F.row_number().over(near)).where("r = 1").drop("r")


@query("f4_drop_first", f"SELECT scenario, year, tas FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY year) AS r FROM (SELECT scenario, year, avg(tas) AS tas FROM ({OBS_SQL}) GROUP BY ALL)) WHERE r > 2", "tas")
def _(s, d):
    return P.drop_first(obs(s, d).groupBy("scenario", "year").agg(F.avg("tas").alias("tas")), ["scenario"], "year", 2)


@query("g1_concat", f"SELECT 'tas' AS kind, scenario, year, avg(tas) AS value FROM ({YEARLY_SQL}) GROUP BY ALL UNION ALL SELECT 'prec', scenario, year, avg(prec) FROM ({YEARLY_SQL}) GROUP BY ALL", "value")
def _(s, d):
    y = yearly(s, d)
    side = lambda c: y.groupBy("scenario", "year").agg(F.avg(c).alias("value")).select(F.lit(c).alias("kind"), "scenario", "year", "value")
    return side("tas").unionByName(side("prec"))


@query("g2_unique", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_mktsegment", "c_nationkey").distinct()
