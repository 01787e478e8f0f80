"""Joins on coordinates (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstats.functions import scalar as S
from gridstats.operators import align as A
from gridstats.operators import season as SE
from gridstats.operators.stats import mean_var_over
from gridstats.plans.registry import query
from gridstats.plans.scan_project import _E as E_SQL
from gridstats.plans.scan_project import _ES as ES_SQL
from gridstats.plans.scan_project import CALIDX_SQL, COEF_SQL, calendar, coef_table, crop_climate
from gridstats.sources import io
from gridstats.sources.derived import OBS_SQL, YEARLY_SQL, ZONE_NAMES_SQL, ZONES_SQL, obs, table, yearly, zone_names, zones

CELLS = ["lat", "lon"]
SCELL_SQL = f"SELECT scenario, lat, lon, avg(tas) AS tas, var_samp(tas) AS tas_var, avg(prec) AS prec, var_samp(prec) AS prec_var, count(*) AS n FROM ({OBS_SQL}) GROUP BY ALL"


def by_scenario(s, d):
    return mean_var_over(obs(s, d), ["scenario", "lat", "lon"], ["tas", "prec"])


def one(df, name):
    return df.where(F.col("scenario") == name).drop("scenario", "n")


def pair_sql(expr: str, a: str = "rcp_a", b: str = "rcp_n") -> str:
    return f"SELECT a.lat, a.lon, {expr} FROM ({SCELL_SQL}) a JOIN ({SCELL_SQL}) b USING (lat, lon) WHERE a.scenario = '{a}' AND b.scenario = '{b}'"


@query("c1_grid_arith", pair_sql("a.tas - b.tas AS tas, a.tas_var + b.tas_var AS tas_var, a.prec - b.prec AS prec, a.prec_var + b.prec_var AS prec_var"), "tas tas_var prec prec_var")
def _(s, d):
    g = by_scenario(s, d)
    return A.grid_arith(one(g, "rcp_a"), one(g, "rcp_n"), CELLS, "sub")


@query("c1_grid_arith_add", pair_sql("a.tas + b.tas AS tas, a.tas_var + b.tas_var AS tas_var, a.prec + b.prec AS prec, a.prec_var + b.prec_var AS prec_var"), "tas tas_var prec prec_var")
def _(s, d):
    g = by_scenario(s, d)
    return A.grid_arith(one(g, "rcp_a"), one(g, "rcp_n"), CELLS, "add")


@query("c2_merge_grids", f"""SELECT coalesce(a.lat, b.lat) AS lat, coalesce(a.lon, b.lon) AS lon, coalesce(a.year, b.year) AS year, a.tas, b.prec FROM
    (SELECT lat, lon, year, avg(tas) AS tas FROM ({OBS_SQL}) WHERE scenario = 'rcp_a' GROUP BY ALL) a FULL OUTER JOIN
    (SELECT lat, lon, year, avg(prec) AS prec FROM ({OBS_SQL}) WHERE scenario = 'rcp_n' AND lat < -10 GROUP BY ALL) b ON a.lat = b.lat AND a.lon = b.lon AND a.year = b.year""", "tas prec")
def _(s, d):
    o = obs(s, d)
    a = o.where("scenario = 'rcp_a'").groupBy("lat", "lon", "year").agg(F.avg("tas").alias("tas"))
    b = o.where("scenario = 'rcp_n' AND lat < -10").groupBy("lat", "lon", "year").agg(F.avg("prec").alias("prec"))
    return A.merge_grids(a, b, ["lat", "lon", "year"]).select("lat", "lon", "year", "tas", "prec")


@query("c3_snap_join", f"""SELECT a.scenario, a.lat, a.lon, a.tas, b.prec FROM ({SCELL_SQL}) a JOIN ({SCELL_SQL}) b USING (scenario, lat, lon)""", "tas prec")
def _(s, d):
    g = by_scenario(s, d)
    noisy = g.select("scenario", (F.col("lat") + 0.0004).alias("lat"), (F.col("lon") - 0.0003).alias("lon"), "prec")
    return A.snap_join(g.select("scenario", "lat", "lon", "tas"), noisy, ["scenario"]).select("scenario", "lat", "lon", "tas", "prec")


def target_axes(s, d):
    """Cells between those of the data, from the data's own."""
    c = obs(s, d).select("lat", "lon").distinct()
    return c.select((F.col("lat") + 1.25).alias("lat"), (F.col("lon") + 1.25).alias("lon"))


_AX = f"SELECT DISTINCT {{0}} FROM ({OBS_SQL})"
NEAREST_SQL = f"""SELECT g.scenario, t.lat + 1.25 AS lat, u.lon + 1.25 AS lon, g.tas FROM ({SCELL_SQL}) g JOIN ({_AX.format('lat')}) t ON t.lat = g.lat AND t.lat + 1.25 <= (SELECT max(lat) FROM ({OBS_SQL}))
    JOIN ({_AX.format('lon')}) u ON u.lon = g.lon AND u.lon + 1.25 <= (SELECT max(lon) FROM ({OBS_SQL}))"""


@query("c4_regrid_nearest", NEAREST_SQL, "tas")
def _(s, d):
    return A.regrid_nearest(by_scenario(s, d).select("scenario", "lat", "lon", "tas"), target_axes(s, d)).select("scenario", "lat", "lon", "tas")


@query("c5_regrid_bilinear", f"""SELECT a.scenario, a.lat + 1.25 AS lat, a.lon + 1.25 AS lon, a.tas * .75 * .75 + b.tas * .75 * .25 + c.tas * .25 * .75 + e.tas * .25 * .25 AS tas FROM ({SCELL_SQL}) a
    JOIN ({SCELL_SQL}) b ON b.scenario = a.scenario AND b.lat = a.lat AND b.lon = a.lon + 5 JOIN ({SCELL_SQL}) c ON c.scenario = a.scenario AND c.lat = a.lat + 5 AND c.lon = a.lon
    JOIN ({SCELL_SQL}) e ON e.scenario = a.scenario AND e.lat = a.lat + 5 AND e.lon = a.lon + 5""", "tas")
def _(s, d):
    return A.regrid_bilinear(by_scenario(s, d).select("scenario", "lat", "lon", "tas"), target_axes(s, d), ["scenario"], ["tas"])


@query("c6_impose_coords", f"SELECT scenario, lat + 0.5 AS lat, lon, tas FROM ({SCELL_SQL})", "tas")
def _(s, d):
    g = by_scenario(s, d).select("scenario", "lat", "lon", "tas")
    return A.impose_coords(g, g.select((F.col("lat") + 0.5).alias("lat")), "lat")


@query("c7_broadcast_along_lat", f"SELECT g.scenario, g.lat, g.lon, g.tas - z.mean AS anomaly FROM ({SCELL_SQL}) g JOIN (SELECT lat, avg(tas) AS mean FROM ({OBS_SQL}) GROUP BY lat) z USING (lat)", "anomaly")
def _(s, d):
    z = obs(s, d).groupBy("lat").agg(F.avg("tas").alias("mean"))
    return A.attach_small(by_scenario(s, d), z, ["lat"]).select("scenario", "lat", "lon", (F.col("tas") - F.col("mean")).alias("anomaly"))


@query("c8_zone_join", f"SELECT scenario, code, name, count(*) AS n FROM ({OBS_SQL}) JOIN ({ZONES_SQL}) USING (lat, lon) JOIN ({ZONE_NAMES_SQL}) USING (code) GROUP BY ALL")
def _(s, d):
    o = A.attach_small(A.attach_small(obs(s, d), zones(s, d), CELLS), zone_names(s, d), ["code"])
    return o.groupBy("scenario", "code", "name").agg(F.count("*").alias("n"))


# Shapes by municipality with a census of many years: here customers' nations with the year's orders of each.
CENSUS_SQL = "SELECT c_nationkey AS codmun, CAST(year(o_orderdate) AS INT) AS year, sum(o_totalprice) / 1e6 AS area, avg(o_totalprice) AS yield FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


def census(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("codmun"))
    return table(s, d, "orders").join(c, "o_custkey").groupBy("codmun", F.year("o_orderdate").alias("year")).agg(
        (F.sum("o_totalprice") / 1e6).alias("area"), F.avg("o_totalprice").alias("yield"))


@query("c9_attach_attributes", f"SELECT n_nationkey AS codmun, n_name, c.year, area, yield FROM nation JOIN ({CENSUS_SQL}) c ON codmun = n_nationkey WHERE c.year = 1996", "area yield", 4)
def _(s, d):
    shapes = table(s, d, "nation").select(F.col("n_nationkey").alias("codmun"), "n_name")
    return A.attach_attributes(shapes, census(s, d), ["codmun"], 1996)


def triangles(s, d):
    """One triangle a region: corners grow with its key."""
    k = F.col("r_regionkey")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(p(288 + 2 * k, F.lit(-32)), p(312 + k, F.lit(-31)), p(300 + k, -22 + 4 * k))
    return table(s, d, "region").select(k.alias("shape_no"), F.array(ring).alias("rings"), (k + 0.5).cast("double").alias("value"))


def _side(x0, y0, x1, y1):
    return f"CASE WHEN (({y0}) > lat) <> (({y1}) > lat) AND lon < (({x1}) - ({x0})) * (lat - ({y0})) / (({y1}) - ({y0})) + ({x0}) THEN 1 ELSE 0 END"


_X, _Y = ("288 + 2 * k", "312 + k", "300 + k"), ("-32", "-31", "-22 + 4 * k")
_INSIDE = " + ".join(_side(_X[i], _Y[i], _X[(i + 1) % 3], _Y[(i + 1) % 3]) for i in range(3))


@query("c10_rasterize", f"""SELECT c.lat, c.lon, coalesce(v, 0) AS value FROM (SELECT DISTINCT lat, lon FROM ({OBS_SQL})) c LEFT JOIN (SELECT lat, lon, max(k) + 0.5 AS v FROM
    (SELECT DISTINCT lat, lon FROM ({OBS_SQL})), (SELECT CAST(r_regionkey AS DOUBLE) AS k FROM region) WHERE ({_INSIDE}) % 2 = 1 GROUP BY ALL) USING (lat, lon)""")
def _(s, d):
    return A.rasterize(obs(s, d).select("lat", "lon").distinct(), triangles(s, d), "value")


PAIRS = [("SEG_CMIP", "rcp_a", "rcp_n"), ("WEG_CMIP", "rcp_r", "rcp_n"), ("WEG_SEG", "rcp_r", "rcp_a")]
PAIRS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in PAIRS) + ") p(effect, l, r)"


def pair_table(s):
    return s.createDataFrame(PAIRS, "effect string, left string, right string")


CONTROL_SQL = f"SELECT p.effect, a.lat, a.lon, a.tas - b.tas AS tas, a.tas_var + b.tas_var AS tas_var FROM {PAIRS_SQL} JOIN ({SCELL_SQL}) a ON a.scenario = l JOIN ({SCELL_SQL}) b ON b.scenario = r AND b.lat = a.lat AND b.lon = a.lon"


@query("c11_control_diff", CONTROL_SQL, "tas tas_var")
def _(s, d):
    return A.control_diff(by_scenario(s, d), pair_table(s), CELLS, ["tas", "tas_var"])


SMONTH_SQL = f"SELECT scenario, month, lat, lon, avg(tas) AS tas, var_samp(tas) AS tas_var FROM ({OBS_SQL}) GROUP BY ALL"
EFFECT_SQL = f"SELECT p.effect, a.month, a.lat, a.lon, a.tas - b.tas AS tas, a.tas_var + b.tas_var AS tas_var FROM {PAIRS_SQL} JOIN ({SMONTH_SQL}) a ON a.scenario = l JOIN ({SMONTH_SQL}) b ON b.scenario = r AND b.month = a.month AND b.lat = a.lat AND b.lon = a.lon"


def effects(s, d):
    m = mean_var_over(obs(s, d), ["scenario", "month", "lat", "lon"], ["tas"]).drop("n")
    return A.control_diff(m, pair_table(s), ["month", "lat", "lon"], ["tas", "tas_var"])


@query("c12_effects", EFFECT_SQL, "tas tas_var")
def _(s, d):
    return effects(s, d)


@query("c13_diff_of_diff", f"SELECT a.month, a.lat, a.lon, a.tas - b.tas AS tas, a.tas_var + b.tas_var AS tas_var FROM ({EFFECT_SQL}) a JOIN ({EFFECT_SQL}) b USING (month, lat, lon) WHERE a.effect = 'WEG_CMIP' AND b.effect = 'SEG_CMIP'", "tas tas_var")
def _(s, d):
    e = effects(s, d)
    at = lambda x: e.where(F.col("effect") == x).drop("effect")
    return A.grid_arith(at("WEG_CMIP"), at("SEG_CMIP"), ["month", "lat", "lon"])


SYEAR_SQL = f"SELECT scenario, lat, lon, year, sum(weight) AS area, sum(prec * weight) AS production FROM ({OBS_SQL}) GROUP BY ALL"


def scenario_years(s, d):
    return obs(s, d).groupBy("scenario", "lat", "lon", "year").agg(F.sum("weight").alias("area"), F.sum(F.col("prec") * F.col("weight")).alias("production"))


@query("c14_reference_period_join", f"SELECT f.scenario, f.lat, f.lon, f.year, f.area, f.production, b.area AS area_base, b.production AS production_base FROM ({SYEAR_SQL}) f JOIN ({SYEAR_SQL}) b USING (scenario, lat, lon) WHERE b.year = 1996 AND f.year = 2000", "area production area_base production_base", 2)
def _(s, d):
    y = scenario_years(s, d)
    return A.reference_period_join(y.where("year = 2000").unionByName(y.where("year = 1996")), ["scenario", "lat", "lon"], 1996, ["area", "production"]).where("year = 2000")


@query("c15_outer_projection_merge", f"""SELECT coalesce(a.lat, b.lat) AS lat, coalesce(a.lon, b.lon) AS lon, coalesce(a.scenario, b.scenario) AS scenario, a.tas, b.pct FROM
    (SELECT scenario, lat, lon, avg(tas) AS tas FROM ({OBS_SQL}) WHERE lat <= -15 GROUP BY ALL) a FULL OUTER JOIN (SELECT scenario, lat, lon, avg(pct) AS pct FROM ({OBS_SQL}) WHERE lon >= 300 GROUP BY ALL) b
    ON a.lat = b.lat AND a.lon = b.lon AND a.scenario = b.scenario""", "tas pct")
def _(s, d):
    o = obs(s, d)
    a = o.where("lat <= -15").groupBy("scenario", "lat", "lon").agg(F.avg("tas").alias("tas"))
    b = o.where("lon >= 300").groupBy("scenario", "lat", "lon").agg(F.avg("pct").alias("pct"))
    return A.merge_grids(a, b, ["scenario", "lat", "lon"]).select("lat", "lon", "scenario", "tas", "pct")


@query("c16_left_attach", f"SELECT g.scenario, g.lat, g.lon, g.tas, v.price FROM ({SCELL_SQL}) g LEFT JOIN (SELECT lat, avg(weight) AS price FROM ({OBS_SQL}) WHERE lat < -20 GROUP BY lat) v USING (lat)", "tas price")
def _(s, d):
    v = obs(s, d).where("lat < -20").groupBy("lat").agg(F.avg("weight").alias("price"))
    return A.attach_small(by_scenario(s, d), v, ["lat"], "left").select("scenario", "lat", "lon", "tas", "price")


DAYS_SQL = f"""SELECT scenario, lat, lon, CAST((year(time) - 1995) * 365 + dayofyear(time) - CASE WHEN dayofyear(make_date(year(time), 12, 31)) = 366 AND dayofyear(time) >= 60 THEN 1 ELSE 0 END - 1 AS INT) AS day_idx,
    tas - 273.15 AS temp, tasmin - 273.15 AS tmin, tasmax - 273.15 AS tmax, prec, greatest({ES_SQL} - {E_SQL}, 0) AS vpd, tasmax - tasmin AS trng FROM ({OBS_SQL}) WHERE year(time) IN (1995, 1996) AND NOT (month(time) = 2 AND day(time) = 29)"""
WINDOW_SQL = f"SELECT x.*, plan, harv FROM ({DAYS_SQL}) x JOIN ({CALIDX_SQL}) c USING (lat, lon) WHERE day_idx >= plan AND day_idx < harv"
#: All days of both years, with what the season's means need; inside: within the calendar's window.
TWO_YEARS_SQL = f"SELECT x.*, plan, harv, day_idx >= plan AND day_idx < harv AS inside FROM ({DAYS_SQL}) x JOIN ({CALIDX_SQL}) c USING (lat, lon)"


def two_years(s, d):
    """Days of 1995 and 1996 with temperatures, rain, vapour pressure deficit and each cell's calendar."""
    days = crop_climate(SE.two_year_days(obs(s, d), 1996)).select(
        "scenario", "lat", "lon", "day_idx", S.kelvin_to_celsius(F.col("tas")).alias("temp"), S.kelvin_to_celsius(F.col("tasmin")).alias("tmin"),
        S.kelvin_to_celsius(F.col("tasmax")).alias("tmax"), "prec", "vpd", (F.col("tasmax") - F.col("tasmin")).alias("trng"))
    return A.attach_small(days, SE.calendar_index(calendar(s, d)).drop("plant_doy", "harvest_doy"), CELLS)


def season_days(s, d):
    """Days of the 1995/96 season of each cell's calendar."""
    return two_years(s, d).where(SE.in_window())


@query("c17_calendar_join", f"SELECT scenario, lat, lon, min(day_idx) AS first_day, max(day_idx) AS last_day, count(*) AS n FROM ({WINDOW_SQL}) GROUP BY ALL")
def _(s, d):
    return season_days(s, d).groupBy("scenario", "lat", "lon").agg(F.min("day_idx").alias("first_day"), F.max("day_idx").alias("last_day"), F.count("*").alias("n"))


VARS_SQL = f"SELECT scenario, member, year, lat, lon, tas - 273.15 AS tempmean, prec AS precmean, prec * prec AS precmean2, tasmax - 295 AS edd FROM ({YEARLY_SQL})"
LONGV_SQL = f"SELECT * FROM (UNPIVOT ({VARS_SQL}) ON tempmean, precmean, precmean2, edd INTO NAME term VALUE x)"
YIELD_SQL = f"SELECT model, scenario, member, year, lat, lon, exp(CASE WHEN count(x) = count(*) THEN sum(estimate * x) END) AS yield FROM ({LONGV_SQL}) JOIN ({COEF_SQL}) USING (term) WHERE term NOT IN ('(Intercept)', 'year') GROUP BY ALL"


def crop_vars(s, d):
    y = yearly(s, d).select("scenario", "member", "year", "lat", "lon", (F.col("tas") - 273.15).alias("tempmean"), F.col("prec").alias("precmean"),
                            (F.col("prec") * F.col("prec")).alias("precmean2"), (F.col("tasmax") - 295).alias("edd"))
    return y.unpivot(["scenario", "member", "year", "lat", "lon"], ["tempmean", "precmean", "precmean2", "edd"], "term", "x")


def linear_predictor(s, d):
    """Sum of estimate times variable over the terms both have, per model; NULL if a variable is missing."""
    both = crop_vars(s, d).join(io.coefficients(coef_table(s, d)), "term")
    total = F.when(F.count("x") == F.count("*"), F.sum(F.col("estimate") * F.col("x")))
    return both.groupBy("model", "scenario", "member", "year", "lat", "lon").agg(total.alias("eta"))


@query("c18_coefficient_join", f"SELECT model, scenario, member, year, lat, lon, ln(yield) AS eta FROM ({YIELD_SQL})", "eta")
def _(s, d):
    return linear_predictor(s, d)


@query("c19_membership_filter", f"SELECT scenario, code, count(*) AS n FROM ({OBS_SQL}) JOIN ({ZONES_SQL}) USING (lat, lon) WHERE code IN (SELECT code FROM ({ZONE_NAMES_SQL}) WHERE name LIKE 'A%') GROUP BY ALL")
def _(s, d):
    o = obs(s, d).join(zones(s, d), CELLS)
    return o.join(zone_names(s, d).where("name LIKE 'A%'"), "code", "left_semi").groupBy("scenario", "code").agg(F.count("*").alias("n"))


@query("c20_topography_join", f"SELECT g.scenario, g.lat, g.lon, g.tas, (g.lat + 30) * 10 + (g.lon - 290) AS topo FROM ({SCELL_SQL}) g", "tas topo")
def _(s, d):
    topo = obs(s, d).select("lat", "lon").distinct().select("lat", (F.col("lon") - 360).alias("lon"), ((F.col("lat") + 30) * 10 + (F.col("lon") - 290)).alias("topo"))
    from gridstats.functions.scalar import lon_to_360

    g = by_scenario(s, d).select("scenario", "lat", "lon", "tas")
    return g.join(A.regrid_nearest(topo.withColumn("lon", lon_to_360(F.col("lon"))), g), CELLS)




@query("h7_yield_level", YIELD_SQL, "yield")
def _(s, d):
    return linear_predictor(s, d).select("model", "scenario", "member", "year", "lat", "lon", F.exp("eta").alias("yield"))


@query("h8_yield_change_pct", f"SELECT a.model, a.member, a.year, a.lat, a.lon, 100 * (a.yield / b.yield - 1) AS change FROM ({YIELD_SQL}) a JOIN ({YIELD_SQL}) b USING (model, member, year, lat, lon) WHERE a.scenario = 'rcp_a' AND b.scenario = 'rcp_n'", "change")
def _(s, d):
    e = linear_predictor(s, d)
    k = ["model", "member", "year", "lat", "lon"]
    at = lambda x: e.where(F.col("scenario") == x).select(*k, "eta")
    return A.grid_arith(at("rcp_a"), at("rcp_n"), k).select(*k, (100 * (F.exp("eta") - 1)).alias("change"))
