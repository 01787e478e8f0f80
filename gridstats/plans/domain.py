"""User-level queries put together from the operators (J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridstats.functions import scalar as S
from gridstats.operators import align as A
from gridstats.operators import inference as I
from gridstats.operators import project as P
from gridstats.operators import season as SE
from gridstats.operators import stats as ST
from gridstats.operators import timegrid as TG
from gridstats.operators import trend as T
from gridstats.operators import vertical as V
from gridstats.plans import aggregates as AG
from gridstats.plans import ordered as O
from gridstats.plans.joins import CELLS, NEAREST_SQL, PAIRS, PAIRS_SQL, SCELL_SQL, YIELD_SQL, by_scenario, linear_predictor, pair_table, target_axes, two_years
from gridstats.plans.registry import query
from gridstats.plans.scan_project import AREA_SQL, PRES_SQL, SEASON_SQL, crop_climate
from gridstats.plans.scan_project import _E as E_SQL
from gridstats.plans.scan_project import _ES as ES_SQL
from gridstats.sources import io
from gridstats.sources.derived import MONTHLY_SQL, OBS_SQL, YEARLY_SQL, ZONE_NAMES_SQL, ZONES_SQL, monthly, obs, yearly, zone_names, zones

MC = ["month", "lat", "lon"]


@query("j1_ensemble_climatology", f"""SELECT scenario, month, lat, lon, lev, t0 + (lev - p0) / (p1 - p0) * (t1 - t0) AS t, tas_var FROM (SELECT x.*, lead(p0) OVER w AS p1, lead(t0) OVER w AS t1 FROM
    (SELECT e.scenario, e.month, e.lat, e.lon, lev_no, hyam * 100000 + hybm * (100000 - 100 * (tas - 285)) AS p0, tas - 40 + 8 * lev_no AS t0, tas_var FROM ({AG.POOL_SQL}) e, {O.LEVELS_SQL}) x WINDOW w AS (PARTITION BY scenario, month, lat, lon ORDER BY p0)), {O.TARGETS_SQL}
    WHERE p1 IS NOT NULL AND (lev >= p0 OR lev_no = 1) AND (lev < p1 OR lev_no = 5)""", "t tas_var", 5)
def _(s, d):
    e = ST.ensemble_stats(AG.clim(s, d).select("scenario", *MC, "tas", "tas_var", "n"), ["scenario", *MC], ["tas"])
    lev = s.createDataFrame(O.LEVELS, "lev_no int, hyam double, hybm double")
    p = V.hybrid_pressure(F.col("hyam"), F.col("hybm"), F.lit(100000.0), 100000 - 100 * (F.col("tas") - 285))
    col = e.crossJoin(F.broadcast(lev)).select("scenario", *MC, "tas_var", p.alias("p"), (F.col("tas") - 40 + 8 * F.col("lev_no")).alias("t"))
    return V.interp_levels(col, ["scenario", *MC, "tas_var"], "p", "t").select("scenario", *MC, "lev", "t", "tas_var")


@query("j2_reference_climatology", f"""SELECT month, lat, lon, avg(prec) AS prec, (coalesce(sum((n - 1) * v), 0) + sum(n * prec * prec) - pow(sum(n * prec), 2) / sum(n)) / nullif(sum(n) - 1, 0) AS prec_var FROM
    (SELECT member, month, lat, lon, avg(prec) * 0.001 AS prec, var_samp(prec) * 0.000001 AS v, count(*) AS n FROM ({MONTHLY_SQL}) WHERE scenario = 'rcp_n' AND year BETWEEN 1995 AND 1999 GROUP BY ALL) GROUP BY month, lat, lon""", "prec prec_var", 8)
def _(s, d):
    m = P.slice_time(monthly(s, d).where("scenario = 'rcp_n'"), 1995, 1999)
    c = ST.monthly_climatology(m, ["prec"], ["member", *MC])
    u = F.lit("kg m-2 s-1")
    c = c.withColumns({"prec": S.convert_flux(F.col("prec"), u), "prec_var": S.convert_flux(F.col("prec_var"), u, 2)})
    return ST.ensemble_stats(c, MC, ["prec"]).drop("n")


@query("j3_difference_map", f"""SELECT season, lat, lon, d * 1.8 AS tas, CASE WHEN p <= 0.4 THEN d * 1.8 END AS masked FROM (SELECT a.season, a.lat, a.lon, a.tas - b.tas AS d, {AG._p('a.tas', 'a.tas_var', 'b.tas', 'b.tas_var', '28', '28')} AS p
    FROM (SELECT scenario, {SEASON_SQL} AS season, lat, lon, avg(tas) AS tas, avg(tas_var) AS tas_var FROM ({AG.SM_SQL}) WHERE lat BETWEEN -25 AND -10 GROUP BY ALL) a JOIN (SELECT scenario, {SEASON_SQL} AS season, lat, lon, avg(tas) AS tas, avg(tas_var) AS tas_var FROM ({AG.SM_SQL}) GROUP BY ALL) b USING (season, lat, lon) WHERE a.scenario = 'rcp_a' AND b.scenario = 'rcp_n')""", "tas masked")
def _(s, d):
    m = P.crop_bbox(AG.by_month(s, d), -25, -10, 0, 360)
    g = m.groupBy("scenario", S.season(F.col("month")).alias("season"), "lat", "lon").agg(F.avg("tas").alias("tas"), F.avg("tas_var").alias("tas_var"))
    c = P.affine_convert(g, {"tas": (1.8, 0.0)})
    t = I.diff_ttest_within(c, "scenario", "rcp_a", "rcp_n", ["season", "lat", "lon"], ["tas"], 28)
    return t.select("season", "lat", "lon", "tas", I.significance_mask(F.col("tas"), F.col("tas_pval"), 0.4).alias("masked"))


@query("j4_effects_masked", f"SELECT p.effect, a.month, a.lat, a.lon, a.tas - b.tas AS tas, CASE WHEN {AG._p('a.tas', 'a.tas_var', 'b.tas', 'b.tas_var', '28', '28')} <= 0.2 THEN a.tas - b.tas END AS masked FROM {PAIRS_SQL} JOIN ({AG.SM_SQL}) a ON a.scenario = l JOIN ({AG.SM_SQL}) b ON b.scenario = r AND b.month = a.month AND b.lat = a.lat AND b.lon = a.lon", "tas masked")
def _(s, d):
    t = I.diff_ttest_pairs(AG.by_month(s, d), "scenario", PAIRS, MC, ["tas"], 28)
    return t.select("effect", *MC, "tas", I.significance_mask(F.col("tas"), F.col("tas_pval"), 0.2).alias("masked"))


@query("j5_daily_harmonisation", O.by_month_sql(O.DAYLIN_SQL.replace(f"FROM ({OBS_SQL})", f"FROM ({OBS_SQL}) WHERE lat <= -15")), "low tas high")
def _(s, d):
    st = O.stamped(P.crop_bbox(obs(s, d), -30, -15, 0, 360))
    return O.by_month(TG.monthly_to_daily(TG.pad_ends(st, O.K), O.K, ["tas"]))


@query("j6_crop_climate", f"SELECT scenario, time, lat, lon, tas - 273.15 AS temp, {PRES_SQL} AS pres, {ES_SQL} AS es, {E_SQL} AS e, greatest({ES_SQL} - {E_SQL}, 0) AS vpd FROM (SELECT scenario, time, lat, lon, avg(tas) AS tas, avg(tasmax) AS tasmax, avg(tasmin) AS tasmin, avg(sphum) AS sphum FROM ({OBS_SQL}) GROUP BY ALL)", "temp pres es e vpd")
def _(s, d):
    g = obs(s, d).groupBy("scenario", "time", "lat", "lon").agg(*[F.avg(c).alias(c) for c in ("tas", "tasmax", "tasmin", "sphum")])
    return crop_climate(g).select("scenario", "time", "lat", "lon", S.kelvin_to_celsius(F.col("tas")).alias("temp"), "pres", "es", "e", "vpd")


@query("j7_season_indices", f"SELECT m.*, g.edd, g.gdd FROM ({AG.ORACLE_D19}) m LEFT JOIN ({AG.ORACLE_D22}) g USING (scenario, lat, lon)", " ".join(f"{c}mean" for c in AG.INDEX_NAMES) + " edd gdd", 5)
def _(s, d):
    return SE.season_indices(two_years(s, d), ["scenario", "lat", "lon"], AG.INDEX_NAMES, SE.in_window(), AG.first_day())


@query("j8_yield_estimate", f"SELECT model, scenario, year, avg(yield) AS yield FROM ({YIELD_SQL}) GROUP BY ALL", "yield")
def _(s, d):
    y = linear_predictor(s, d).withColumn("yield", F.exp("eta"))
    return y.groupBy("model", "scenario", "year").agg(F.avg("yield").alias("yield"))


@query("j9_yield_trend", f"SELECT model, scenario, lat, lon, 100 * slope / m AS trend FROM (SELECT model, scenario, lat, lon, regr_slope(y, year) AS slope, avg(CASE WHEN year <= 1997 THEN y END) AS m FROM (SELECT model, scenario, lat, lon, year, avg(yield) AS y FROM ({YIELD_SQL}) GROUP BY ALL) GROUP BY ALL)", "trend")
def _(s, d):
    y = linear_predictor(s, d).groupBy("model", "scenario", "lat", "lon", "year").agg(F.avg(F.exp("eta")).alias("y"))
    k = ["model", "scenario", "lat", "lon"]
    mean = y.where("year <= 1997").groupBy(*k).agg(F.avg("y").alias("m"))
    return T.trend_slope(y, k, "year", ["y"]).join(mean, k).select(*k, F.try_divide(100 * F.col("y"), F.col("m")).alias("trend"))


#: The bootstrap's SQL over yearly yields instead of temperatures.
_BOOT = AG.BOOT_SQL.replace(f"avg(tas) AS tas FROM ({OBS_SQL})", f"avg(yield) AS tas FROM ({YIELD_SQL})")


@query("j9_yield_trend_bootstrap", f"SELECT scenario, lat, lon, tas AS y, tas_var AS y_var FROM ({_BOOT})", "y y_var", 9)
def _(s, d):
    y = linear_predictor(s, d).groupBy("scenario", "lat", "lon", "year").agg(F.avg(F.exp("eta")).alias("y"))
    return T.trend_bootstrap(y, ["scenario", "lat", "lon"], "year", "y", nsamp=500)


_PER = f"SELECT scenario, lat, lon, avg(tas) AS tas, var_samp(tas) AS v FROM ({YEARLY_SQL}) WHERE year BETWEEN {{}} AND {{}} GROUP BY ALL"


@query("j10_future_deltas", f"SELECT scenario, lat, lon, a.tas - b.tas AS tas, {AG._p('a.tas', 'a.v', 'b.tas', 'b.v', '12', '12')} AS tas_pval, 100 * (a.tas - b.tas) / b.tas AS tas_perc FROM ({_PER.format(1999, 2001)}) a JOIN ({_PER.format(1995, 1997)}) b USING (scenario, lat, lon)", "tas tas_pval tas_perc")
def _(s, d):
    k = ["scenario", "lat", "lon"]
    # One pass over the years from the first period to the last; each row belongs to one of the periods or to none.
    o = io.scan_months(obs(s, d), 1995, 2001, None, "time")
    period = F.when(F.col("year") >= 1999, "future").when(F.col("year") <= 1997, "past")
    years = o.withColumn("period", period).where("period IS NOT NULL").groupBy("period", "member", "year", *k).agg(F.avg("tas").alias("tas"))
    part = ST.mean_var_over(years, ["period", *k], ["tas"])
    return I.diff_ttest_within(part, "period", "future", "past", k, ["tas"], 12, percent=True).select(*k, "tas", "tas_pval", "tas_perc")


@query("j11_rainy_extension", f"""WITH r AS MATERIALIZED ({O.RAINY_SQL}), ref AS (SELECT lat, lon, avg(outslen) AS ref FROM r WHERE scenario = 'rcp_n' GROUP BY lat, lon)
    SELECT r.*, ref.ref AS outslen_ref, m.m - ref.ref AS outslen_bias FROM r JOIN (SELECT scenario, member, lat, lon, avg(outslen) AS m FROM r GROUP BY ALL) m USING (scenario, member, lat, lon) LEFT JOIN ref USING (lat, lon)""", "outslen_ref outslen_bias")
def _(s, d):
    r = O.seasons(s, d)
    ref = r.where("scenario = 'rcp_n'").groupBy("lat", "lon").agg(F.avg("outslen").alias("outslen_ref"))
    with_mean = r.withColumn("m", F.avg("outslen").over(Window.partitionBy(*O.K)))  # the season's own layout
    return with_mean.join(ref, ["lat", "lon"], "left").withColumn("outslen_bias", F.col("m") - F.col("outslen_ref")).drop("m")


@query("j12_rainy_ensemble", f"""WITH r AS MATERIALIZED ({O.RAINY_SQL})
    SELECT s.scenario, la.lat, lo.lon, v.outoday, v.outoday_var, v.outslen, v.outslen_var, (SELECT count(DISTINCT ag_year) * count(DISTINCT member) FROM r) AS n FROM (SELECT DISTINCT scenario FROM r) s, (SELECT DISTINCT lat FROM r) la, (SELECT DISTINCT lon FROM r) lo
    LEFT JOIN (SELECT scenario, lat, lon, avg(outoday) AS outoday, var_samp(outoday) AS outoday_var, avg(outslen) AS outslen, var_samp(outslen) AS outslen_var FROM r GROUP BY ALL) v ON v.scenario = s.scenario AND v.lat = la.lat AND v.lon = lo.lon""", "outoday outoday_var outslen outslen_var")
def _(s, d):
    r = O.seasons(s, d).persist()  # read for its axes and for its means
    return ST.mean_var_over(r, ["scenario", "lat", "lon"], ["outoday", "outslen"], dims=["ag_year", "member"])


@query("j13_bias_corrected", f"""WITH r AS MATERIALIZED ({O.RAINY_SQL}), y AS (SELECT scenario, lat, lon, ag_year, avg(outslen) AS outslen FROM r GROUP BY ALL)
    SELECT scenario, lat, lon, CASE WHEN x IS NOT NULL THEN least(greatest(x, 0), 365) END AS outslen FROM (SELECT scenario, lat, lon, CASE WHEN count(*) - count(outslen) <= 3 THEN regr_slope(outslen, ag_year) END * 39 + any_value(ref) AS x
        FROM y LEFT JOIN (SELECT lat, lon, avg(outslen) AS ref FROM r WHERE scenario = 'rcp_n' GROUP BY lat, lon) USING (lat, lon) GROUP BY scenario, lat, lon)""", "outslen")
def _(s, d):
    r = O.seasons(s, d)
    ref = r.where("scenario = 'rcp_n'").groupBy("lat", "lon").agg(F.avg("outslen").alias("ref"))
    by_year = r.groupBy("scenario", "lat", "lon", "ag_year").agg(F.avg("outslen").alias("outslen"))
    t = T.trend_slope(by_year, ["scenario", "lat", "lon"], "ag_year", ["outslen"]).join(ref, ["lat", "lon"], "left")
    return t.select("scenario", "lat", "lon", S.clamp(F.col("outslen") * 39 + F.col("ref"), 0, 365).alias("outslen"))


DEF_SQL = f"SELECT scenario, year, lat, lon, coalesce(sum(pct) FILTER (pft IN (1, 2, 3)), 0) AS pct FROM ({OBS_SQL}) GROUP BY scenario, year, lat, lon"


def classes(s, d):
    return ST.class_sum(obs(s, d), ["scenario", "year", "lat", "lon"], "pft", AG.PFT, "pct")


@query("j14_deforestation_delta", f"SELECT a.scenario, code, avg(a.pct - b.pct) AS change FROM ({DEF_SQL}) a JOIN ({DEF_SQL}) b ON a.scenario = b.scenario AND a.lat = b.lat AND a.lon = b.lon JOIN ({ZONES_SQL}) z ON z.lat = a.lat AND z.lon = a.lon WHERE a.year = 2000 AND b.year = 1996 GROUP BY ALL", "change")
def _(s, d):
    c = classes(s, d)
    at = lambda y: c.where(F.col("year") == y).drop("year")
    change = A.grid_arith(at(2000), at(1996), ["scenario", "lat", "lon"])
    return A.attach_small(change, zones(s, d), CELLS).groupBy("scenario", "code").agg(F.avg("pct").alias("change"))


@query("j15_deforestation_share", f"SELECT scenario, lat, lon, greatest(least(coalesce(1 - a / nullif(b, 0), 0), 1), 0) AS share FROM (SELECT scenario, lat, lon, sum(pct) FILTER (pft <= 3 AND year >= 1999) AS a, sum(pct) FILTER (pft <= 3 AND year <= 1997) AS b FROM ({OBS_SQL}) GROUP BY ALL)", "share")
def _(s, d):
    part = lambda cond: F.sum(F.when((F.col("pft") <= 3) & cond, F.col("pct")))
    g = obs(s, d).groupBy("scenario", "lat", "lon").agg(part(F.col("year") >= 1999).alias("a"), part(F.col("year") <= 1997).alias("b"))
    return g.select("scenario", "lat", "lon", S.clamp(F.coalesce(1 - F.try_divide(F.col("a"), F.col("b")), F.lit(0.0)), 0, 1).alias("share"))


@query("j16_deforestation_series", f"SELECT scenario, name, year, avg(pct) AS pct FROM ({DEF_SQL}) JOIN ({ZONES_SQL}) USING (lat, lon) JOIN ({ZONE_NAMES_SQL}) USING (code) GROUP BY ALL", "pct")
def _(s, d):
    c = A.attach_small(A.attach_small(classes(s, d), zones(s, d), CELLS), zone_names(s, d), ["code"])
    return c.groupBy("scenario", "name", "year").agg(F.avg("pct").alias("pct"))


@query("j17_map_preparation", f"SELECT 'weg' AS luscenario, year, lat, lon, pct FROM (SELECT year, lat, lon, avg(pct) AS pct FROM ({OBS_SQL}) WHERE lat BETWEEN -25 AND -10 AND year BETWEEN 1996 AND 2000 GROUP BY ALL)", "pct")
def _(s, d):
    e = obs(s, d).select("year", "pct", F.col("lat").alias("i"), F.col("lon").alias("j"), (F.col("lat") + 2.5).alias("nn"), (F.col("lat") - 2.5).alias("ss"), (F.col("lon") + 2.5).alias("ee"), (F.col("lon") - 2.5).alias("ww"))
    c = P.slice_time(P.crop_bbox(P.cell_centers(e, "nn", "ss", "ee", "ww", "i", "j"), -25, -10, 0, 360), 1996, 2000)
    return c.groupBy("year", "lat", "lon").agg(F.avg("pct").alias("pct")).withColumn("luscenario", F.lit("weg"))


#: Two crops with a share of the municipality's area each, for every year of the census; one raster a crop and year.
CROPS = [("single", 1.0), ("maize", 0.4)]
CENSUS_YEARS = range(1995, 2002)
_CROPS_SQL = "(VALUES " + ", ".join(f"('{c}', {x})" for c, x in CROPS) + ") crops(crop, part)"
J18_SQL = f"""WITH c AS (SELECT DISTINCT lat, lon FROM ({OBS_SQL})), census AS (SELECT crop, k, year, part * (k + 0.5 + year - 1995) AS share, yield FROM {_CROPS_SQL},
        (SELECT CAST(r_regionkey AS DOUBLE) AS k FROM region), (SELECT year, avg(prec) AS yield FROM ({OBS_SQL}) GROUP BY year) WHERE NOT (crop = 'maize' AND k = 1)),
    inside AS (SELECT lat, lon, crop, year, arg_max(share, k) AS share, arg_max(yield + k, k) AS yield FROM c, census WHERE ({AG.INSIDE_SQL}) % 2 = 1 GROUP BY ALL)
    SELECT y.crop, c.lat, c.lon, y.year, coalesce(share, 0) / 100 * {AREA_SQL.replace('lat', 'c.lat')} AS area, coalesce(share, 0) / 100 * {AREA_SQL.replace('lat', 'c.lat')} * coalesce(yield, 0) * 100 AS production
    FROM c CROSS JOIN (SELECT DISTINCT crop, year FROM census) y LEFT JOIN inside i ON i.lat = c.lat AND i.lon = c.lon AND i.crop = y.crop AND i.year = y.year"""


@query("j18_census_raster", J18_SQL, "area production", 3)
def _(s, d):
    from gridstats.plans.joins import triangles

    o = obs(s, d)
    # Shapes get their attributes by municipality and year, then each row's stretches are found once for all crops and years.
    crops = F.explode(F.array(*[F.struct(F.lit(c).alias("crop"), F.lit(x).alias("part")) for c, x in CROPS])).alias("c")
    yields = o.groupBy("year").agg(F.avg("prec").alias("yield"))
    share = F.col("c.part") * (F.col("shape_no") + 0.5 + F.col("year") - 1995)
    shapes = triangles(s, d).select("shape_no", "rings", F.explode(F.array(*[F.lit(y) for y in CENSUS_YEARS])).alias("year"))
    census = shapes.select("shape_no", "year", crops).where("NOT (c.crop = 'maize' AND shape_no = 1)").join(yields, "year").select(
        "shape_no", "year", F.col("c.crop").alias("crop"), share.alias("share"), (F.col("yield") + F.col("shape_no")).alias("yield"))
    return A.rasterize_attributes(
        o.select("lat", "lon").distinct(), triangles(s, d), census, ["crop", "year"], ["share", "yield"]
    ).select("crop", "lat", "lon", "year", *census_columns())


def census_columns():
    """Area in km2 from the share of the cell, production from area and yield."""
    area = F.col("share") / 100 * S.pixel_area(F.col("lat"), F.lit(5.0), F.lit(5.0))
    return area.alias("area"), (area * F.col("yield") * 100).alias("production")


@query("j19_biome_summary", f"""SELECT scenario, ensemble, code, month, avg(tas) AS tas FROM (SELECT *, count(*) OVER (PARTITION BY run, lat, lon) AS n, row_number() OVER (PARTITION BY run, lat, lon ORDER BY ym) AS r FROM
    (SELECT regexp_extract(run, '^(.*)_([^_]*)$', 1) AS scenario, regexp_extract(run, '^(.*)_([^_]*)$', 2) AS ensemble, * FROM (SELECT scenario || '_' || member AS run, year * 100 + month AS ym, month, lat, lon, tas FROM ({MONTHLY_SQL}) WHERE lat >= -25))) JOIN ({ZONES_SQL}) USING (lat, lon) WHERE n % 2 = 0 OR r > 1 GROUP BY ALL""", "tas")
def _(s, d):
    m = P.crop_bbox(monthly(s, d), -25, 90, 0, 360).withColumns({"run": F.concat_ws("_", "scenario", "member"), "ym": F.col("year") * 100 + F.col("month")})
    m = P.drop_first_if_odd(m, ["run", "lat", "lon"], "ym").withColumns({"scenario": S.run_part(F.col("run"), 1), "ensemble": S.run_part(F.col("run"), 2)})
    return A.attach_small(m, zones(s, d), CELLS).groupBy("scenario", "ensemble", "code", "month").agg(F.avg("tas").alias("tas"))


@query("j20_regional_table", f"SELECT name, max(v) FILTER (scenario = 'rcp_a') AS rcp_a, max(v) FILTER (scenario = 'rcp_n') AS rcp_n, max(v) FILTER (scenario = 'rcp_r') AS rcp_r FROM (SELECT name, scenario, sum(tas * weight) / sum(weight) AS v FROM ({OBS_SQL}) JOIN ({ZONES_SQL}) USING (lat, lon) JOIN ({ZONE_NAMES_SQL}) USING (code) GROUP BY ALL) GROUP BY name", "rcp_a rcp_n rcp_r")
def _(s, d):
    o = P.recode(A.attach_small(obs(s, d), zones(s, d), CELLS), zone_names(s, d))
    w = ST.weighted_mean(o, ["name", "scenario"], ["tas"], "weight")
    return P.spread_vars(w, ["name"], "scenario", ["rcp_a", "rcp_n", "rcp_r"], "tas")


@query("j21_effect_regressions", f"SELECT effect, lat, n, slope, intercept, r2 FROM (SELECT p.effect, a.lat, CAST(regr_count(a.tas - b.tas, a.prec - b.prec) AS BIGINT) AS n, regr_slope(a.tas - b.tas, a.prec - b.prec) AS slope, regr_intercept(a.tas - b.tas, a.prec - b.prec) AS intercept, regr_r2(a.tas - b.tas, a.prec - b.prec) AS r2 FROM {PAIRS_SQL} JOIN ({SCELL_SQL}) a ON a.scenario = l JOIN ({SCELL_SQL}) b ON b.scenario = r AND b.lat = a.lat AND b.lon = a.lon GROUP BY ALL)", "slope intercept r2")
def _(s, d):
    e = A.control_diff(by_scenario(s, d), pair_table(s), CELLS, ["tas", "prec"])
    return T.regression_summary(e, ["effect", "lat"], "prec", "tas").select("effect", "lat", "n", "slope", "intercept", "r2")


PROJ_SQL = f"""SELECT scenario, code, 100 * (f - b) / b AS change, (f - b) * price AS worth FROM (SELECT scenario, code, sum(area * y * (1 + delta / 100) * 100) AS f, sum(area * y * 100) AS b FROM (SELECT g.scenario, g.lat, g.lon, g.area, coalesce(g.y, (SELECT sum(prec * weight) / sum(weight) FROM ({OBS_SQL}))) AS y, h.delta FROM
    (SELECT scenario, lat, lon, sum(weight) / 1e6 AS area, avg(CASE WHEN pft <> 4 OR lat < -20 THEN prec END) AS y FROM ({OBS_SQL}) WHERE year = 1996 GROUP BY ALL) g JOIN
    (SELECT scenario, lat, lon, 100 * (avg(tas) FILTER (year >= 1999) - avg(tas) FILTER (year <= 1997)) / avg(tas) FILTER (year <= 1997) AS delta FROM ({OBS_SQL}) GROUP BY ALL) h USING (scenario, lat, lon)) JOIN ({ZONES_SQL}) USING (lat, lon) GROUP BY ALL), (SELECT avg(weight) / 1000 AS price FROM ({OBS_SQL}) WHERE year BETWEEN 1996 AND 1999)"""


@query("j22_production_projection", PROJ_SQL, "change worth", 4)
def _(s, d):
    k = ["scenario", "lat", "lon"]
    when = lambda c, x: F.when(c, x)
    year, base = F.col("year"), F.col("year") == 1996
    # One pass: what the whole table's means need are sums of the cells' sums.
    cell = obs(s, d).groupBy(*k).agg(
        (F.sum(when(base, F.col("weight"))) / 1e6).alias("area"), F.avg(when(base & ((F.col("pft") != 4) | (F.col("lat") < -20)), F.col("prec"))).alias("y"),
        F.avg(when(year <= 1997, F.col("tas"))).alias("past"), F.avg(when(year >= 1999, F.col("tas"))).alias("future"),
        F.sum(F.col("prec") * F.col("weight")).alias("pw"), F.sum("weight").alias("w"),
        F.sum(when(year.between(1996, 1999), F.col("weight"))).alias("priced"), F.count(when(year.between(1996, 1999), F.col("weight"))).alias("n_priced"))
    mean = cell.agg(F.try_divide(F.sum("pw"), F.sum("w")).alias("fill"), F.try_divide(F.sum("priced"), F.sum("n_priced") * 1000).alias("price"))
    delta = S.percent_diff(F.col("future"), F.col("past")).alias("delta")
    both = A.attach_small(cell.where("area IS NOT NULL").select(*k, "area", "y", delta), zones(s, d), CELLS).crossJoin(F.broadcast(mean))
    y0 = F.coalesce("y", "fill")
    g = both.groupBy("scenario", "code", "price").agg(F.sum(F.col("area") * y0 * (1 + F.col("delta") / 100) * 100).alias("f"), F.sum(F.col("area") * y0 * 100).alias("b"))
    return g.select("scenario", "code", S.percent_diff(F.col("f"), F.col("b")).alias("change"), ((F.col("f") - F.col("b")) * F.col("price")).alias("worth"))


@query("j23_region_month_summary", f"SELECT code, month, variable, avg(value) AS value FROM (UNPIVOT (SELECT code, month, tas, prec FROM ({MONTHLY_SQL}) JOIN ({ZONES_SQL}) USING (lat, lon)) ON tas, prec INTO NAME variable VALUE value) GROUP BY ALL", "value")
def _(s, d):
    m = A.attach_small(monthly(s, d), zones(s, d), CELLS)
    return P.stack_vars(m, ["code", "month"], ["tas", "prec"]).groupBy("code", "month", "variable").agg(F.avg("value").alias("value"))


@query("j24_period_significance", f"SELECT lat, lon, diff, pvalue, CASE WHEN pvalue <= 0.5 THEN diff END AS masked FROM ({AG.SAMPLES_SQL})", "diff pvalue masked")
def _(s, d):
    y = yearly(s, d)
    t = I.ttest_samples(y.where("year <= 1997"), y.where("year >= 1999"), CELLS, "tas")
    return t.select("lat", "lon", "diff", "pvalue", I.significance_mask(F.col("diff"), F.col("pvalue"), 0.5).alias("masked"))


@query("j25_moisture_budget", f"SELECT c.scenario, c.lat, c.lon, sum(c.conv * 1e6 * t.dp / 9.81) AS budget FROM ({O.CONV_SQL}) c JOIN (SELECT scenario, lat, lon, CASE WHEN raw > 0 THEN raw END AS dp FROM ({O.THICK_SQL}) WHERE month = 1) t USING (scenario, lat, lon) GROUP BY ALL", "budget", 4)
def _(s, d):
    conv = V.convergence(O.flux(s, d), ["scenario"], "fx", "fy")
    dp = V.layer_thickness(O.columns(s, d).where("month = 1"), O.CK, "p", "ps", 100.0)
    both = conv.join(dp.select("scenario", "lat", "lon", "dp"), ["scenario", "lat", "lon"])
    return both.groupBy("scenario", "lat", "lon").agg(F.sum(F.col("conv") * 1e6 * F.col("dp") / 9.81).alias("budget"))


@query("j26_landuse_area", f"SELECT scenario, lat, lon, tas / 1000 * (2 * pi() * 6356.7523 * 5 / 360 * 2 * pi() * 6378.137 * cos(radians(lat)) * 5 / 360) AS area FROM ({NEAREST_SQL})", "area", 5)
def _(s, d):
    g = A.regrid_nearest(by_scenario(s, d).select("scenario", "lat", "lon", "tas"), target_axes(s, d))
    return g.select("scenario", "lat", "lon", (F.col("tas") / 1000 * S.pixel_area(F.col("lat"), F.lit(5.0), F.lit(5.0))).alias("area"))


@query("j27_biome_envelope", f"SELECT year, month, avg(tas) AS mean, min(tas) AS low, max(tas) AS high FROM (SELECT member, year, month, avg(tas) AS tas FROM ({MONTHLY_SQL}) JOIN ({ZONES_SQL}) USING (lat, lon) WHERE code = 2 GROUP BY ALL) GROUP BY ALL", "mean low high")
def _(s, d):
    m = A.attach_small(monthly(s, d), zones(s, d), CELLS).where("code = 2").groupBy("member", "year", "month").agg(F.avg("tas").alias("tas"))
    return ST.envelope(m, ["year", "month"], "tas")

