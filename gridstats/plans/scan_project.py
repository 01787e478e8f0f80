"""Sources, projections and scalar functions (A, B, H)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from gridstats.functions import scalar as S
from gridstats.operators import project as P
from gridstats.operators import season as SE
from gridstats.plans.registry import query
from gridstats.sources import io
from gridstats.sources.derived import CLIM_SQL, MONTHLY_SQL, OBS_SQL, YEARLY_SQL, ZONE_NAMES_SQL, ZONES_SQL, monthly, obs, table, yearly, zone_names, zones
from gridstats.operators.stats import monthly_climatology

MKEYS = "scenario, member, year, month, lat, lon"


@query("a2_scan_months", f"SELECT scenario, year, month, count(*) AS n, sum(prec) AS prec FROM ({OBS_SQL}) WHERE year BETWEEN 1996 AND 1998 AND month IN (6, 7, 8) GROUP BY ALL", "prec")
def _(s, d):
    return io.scan_months(obs(s, d), 1996, 1998, (6, 7, 8), "time").groupBy("scenario", "year", "month").agg(F.count("*").alias("n"), F.sum("prec").alias("prec"))


def kept(s, name, write):
    """A folder of its own in the cluster's shared folder (in local runs a new temporary one), filled by write(path)."""
    base = s.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    write(path)
    return path


@query("a1_scan_runs", f"SELECT scenario, CAST(member AS VARCHAR) AS member, count(*) AS n, sum(prec) AS prec FROM ({OBS_SQL}) GROUP BY ALL", "prec")
def _(s, d):
    o = obs(s, d).select(F.concat_ws("_", "scenario", "member").alias("run"), "time", "lat", "lon", "prec")
    path = kept(s, "runs", lambda p: o.write.partitionBy("run").parquet(p))
    return io.scan_runs(s, path).groupBy("scenario", "member").agg(F.count("*").alias("n"), F.sum("prec").alias("prec"))


@query("a3_scan_all", f"SELECT year, count(tas) AS n_tas, count(rain) AS n_rain, sum(rain) AS rain FROM (SELECT year, tas, NULL AS rain FROM ({MONTHLY_SQL}) WHERE year <= 1997 UNION ALL SELECT year, tas, prec FROM ({MONTHLY_SQL}) WHERE year > 1997) GROUP BY ALL", "rain")
def _(s, d):
    m = monthly(s, d)
    old = kept(s, "old", lambda p: io.write_grid(m.where("year <= 1997").select("year", "tas"), p))
    new = kept(s, "new", lambda p: io.write_grid(m.where("year > 1997").select("year", "tas", F.col("prec").alias("rain")), p))
    return io.scan_all(s, old, new).groupBy("year").agg(F.count("tas").alias("n_tas"), F.count("rain").alias("n_rain"), F.sum("rain").alias("rain"))


@query("a7_read_codes", "SELECT CAST(n_nationkey AS INT) AS code, n_name AS name FROM nation")
def _(s, d):
    codes = table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("code"), F.col("n_name").alias("name"))
    return io.read_codes(s, kept(s, "codes", lambda p: io.write_summary_csv(codes, p)))


@query("a9_write_grid", f"SELECT scenario, lat, lon, avg(tas) AS tas FROM ({OBS_SQL}) GROUP BY ALL", "tas")
def _(s, d):
    grid = obs(s, d).groupBy("scenario", "lat", "lon").agg(F.avg("tas").alias("tas"))

    def parts(path):
        io.write_grid(grid.where("scenario = 'rcp_a'"), path)
        io.write_grid(grid.where("scenario <> 'rcp_a'"), path, mode="append")

    return s.read.parquet(kept(s, "grid", parts))


@query("a10_write_yearly", f"SELECT scenario, member, year, count(*) AS n, sum(prec + CASE WHEN year = 1996 THEN 1 ELSE 0 END) AS prec FROM ({OBS_SQL}) GROUP BY ALL", "prec")
def _(s, d):
    o = obs(s, d).select("scenario", "member", "year", "lat", "lon", "prec")

    def years(path):
        io.write_yearly(o, path)
        io.write_yearly(o.where("year = 1996").withColumn("prec", F.col("prec") + 1), path)  # only those folders are replaced

    return s.read.parquet(kept(s, "yearly", years)).groupBy("scenario", "member", "year").agg(F.count("*").alias("n"), F.sum("prec").alias("prec"))


@query("a11_clean_before_write", f"SELECT scenario, count(*) AS n FROM ({OBS_SQL}) WHERE year = 2000 GROUP BY ALL")
def _(s, d):
    o = obs(s, d).select("scenario", "year", "tas")

    def twice(path):
        io.write_grid(o, path)
        io.write_grid(o.where("year = 2000"), path)  # what was there goes

    return s.read.parquet(kept(s, "clean", twice)).groupBy("scenario").agg(F.count("*").alias("n"))


@query("a12_write_summary_csv", f"SELECT scenario, CAST(month AS INT) AS month, avg(tas) AS tas FROM ({MONTHLY_SQL}) GROUP BY ALL", "tas")
def _(s, d):
    summary = monthly(s, d).groupBy("scenario", F.col("month").cast("int").alias("month")).agg(F.avg("tas").alias("tas"))
    return s.read.csv(kept(s, "summary", lambda p: io.write_summary_csv(summary, p)), header=True, schema="scenario string, month int, tas double")


@query("a13_compressed_output", f"SELECT scenario, year, sum(prec) AS prec, count(*) AS n FROM ({OBS_SQL}) GROUP BY ALL", "prec")
def _(s, d):
    o = obs(s, d).select("scenario", "year", "prec")
    read = s.read.parquet(*[kept(s, f"packed-{c}", lambda p, i=i, c=c: io.write_grid(o.where(F.col("year") % 2 == i), p, compression=c)) for i, c in enumerate(("zstd", "gzip"))])
    return read.groupBy("scenario", "year").agg(F.sum("prec").alias("prec"), F.count("*").alias("n"))


@query("b2_drop_bounds", f"SELECT scenario, lat, avg(tas) AS tas FROM ({OBS_SQL}) GROUP BY ALL", "tas")
def _(s, d):
    o = obs(s, d).withColumns({"lat_bnds": F.array(F.col("lat") - 2.5, F.col("lat") + 2.5), "time_bnds": F.array("time", "time")})
    kept_columns = P.drop_bounds(o.groupBy("scenario", "lat").agg(F.avg("tas").alias("tas"), F.first("lat_bnds").alias("lat_bnds"), F.first("time_bnds").alias("time_bnds")))
    return kept_columns


@query("a4_tag_and_stack", f"""SELECT period, scenario, count(*) AS n, avg(tas) AS tas, avg(rain) AS rain FROM (
    SELECT 'historical' AS period, scenario, tas, NULL AS rain FROM ({MONTHLY_SQL}) WHERE year BETWEEN 1995 AND 1997
    UNION ALL SELECT 'future', scenario, tas, prec FROM ({MONTHLY_SQL}) WHERE year BETWEEN 1999 AND 2001) GROUP BY ALL""", "tas rain")
def _(s, d):
    m = monthly(s, d)
    both = io.tag_and_stack([
        ({"period": "historical"}, P.slice_time(m, 1995, 1997).select("scenario", "tas")),
        ({"period": "future"}, P.slice_time(m, 1999, 2001).select("scenario", "tas", F.col("prec").alias("rain"))),
    ])
    return both.groupBy("period", "scenario").agg(F.count("*").alias("n"), F.avg("tas").alias("tas"), F.avg("rain").alias("rain"))


@query("a5_split_run_name", """SELECT event_type, regexp_extract(event_type || '_r' || (event_id % 3), '^(.*)_([^_]*)$', 1) AS scenario,
    regexp_extract(event_type || '_r' || (event_id % 3), '^(.*)_([^_]*)$', 2) AS ensemble, count(*) AS n FROM events GROUP BY ALL""")
def _(s, d):
    e = table(s, d, "events")
    name = F.concat("event_type", F.lit("_r"), (F.col("event_id") % 3).cast("string"))
    return e.groupBy("event_type", S.run_part(name, 1).alias("scenario"), S.run_part(name, 2).alias("ensemble")).agg(F.count("*").alias("n"))


_TWO = f"""SELECT scenario, CAST((year(time) - 1995) * 365 + dayofyear(time) - CASE WHEN dayofyear(make_date(year(time), 12, 31)) = 366 AND dayofyear(time) >= 60 THEN 1 ELSE 0 END - 1 AS INT) AS day_idx,
    tas FROM ({OBS_SQL}) WHERE year(time) IN (1995, 1996) AND NOT (month(time) = 2 AND day(time) = 29)"""


@query("a6_scan_two_years", f"SELECT scenario, day_idx, count(*) AS n, avg(tas) AS tas FROM ({_TWO}) GROUP BY ALL", "tas")
def _(s, d):
    return SE.two_year_days(obs(s, d), 1996).groupBy("scenario", "day_idx").agg(F.count("*").alias("n"), F.avg("tas").alias("tas"))


_COEF = """SELECT * FROM (VALUES ('(Intercept)', 1.5, 0.2), ('year', 0.01, 0.001), ('tempmean', -0.05, 0.01), ('precmean', 0.02, 0.005), ('precmean2', -0.001, 0.0004), ('edd', -0.004, 0.0005)) t(term, estimate, std_error)"""


def coef_table(s, d):
    """Model terms, one set per region of the test tables."""
    rows = [("(Intercept)", 1.5, 0.2), ("year", 0.01, 0.001), ("tempmean", -0.05, 0.01), ("precmean", 0.02, 0.005), ("precmean2", -0.001, 0.0004), ("edd", -0.004, 0.0005)]
    t = s.createDataFrame(rows, "term string, estimate double, std_error double")
    r = table(s, d, "region").select(F.concat(F.lit("model"), F.col("r_regionkey").cast("string")).alias("model"), F.col("r_regionkey").alias("k"))
    return r.crossJoin(F.broadcast(t)).select("model", "term", (F.col("estimate") * (1 + F.col("k") / 10)).alias("estimate"), "std_error")


COEF_SQL = f"SELECT 'model' || r_regionkey AS model, term, estimate * (1 + r_regionkey / 10) AS estimate, std_error FROM region, ({_COEF})"


@query("a8_read_coefficients", f"SELECT model, replace(term, 'tempmean', 'temp') AS term, estimate, power(std_error, 2) AS estimate_var FROM ({COEF_SQL}) WHERE term NOT IN ('(Intercept)', 'year')", "estimate estimate_var", 9)
def _(s, d):
    return io.coefficients(coef_table(s, d), {"tempmean": "temp"})


@query("a14_dedupe_inputs", "SELECT event_type, min(event_id) AS first_id FROM events GROUP BY event_type")
def _(s, d):
    # Order-keeping: the first row of each name by its id.
    return table(s, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first_id"))


@query("a15_skip_absent", f"""SELECT w.scenario, w.member FROM (SELECT 'rcp_' || x AS scenario, CAST(s_suppkey % 6 AS INT) AS member FROM supplier, (VALUES ('a'), ('n'), ('z')) t(x) GROUP BY ALL) w
    LEFT JOIN (SELECT DISTINCT scenario, member FROM ({OBS_SQL})) h USING (scenario, member) WHERE h.scenario IS NULL""")
def _(s, d):
    names = F.explode(F.array(*[F.lit(f"rcp_{x}") for x in "anz"])).alias("scenario")
    wanted = table(s, d, "supplier").select((F.col("s_suppkey") % 6).cast("int").alias("member"), names).distinct()
    return io.absent_pairs(wanted, obs(s, d), ["scenario", "member"]).select("scenario", "member")


@query("b1_select_vars", f"SELECT scenario, member, month, lat, lon, tas, tas_var, n FROM ({CLIM_SQL})", "tas tas_var")
def _(s, d):
    return P.select_vars(monthly_climatology(monthly(s, d), ("tas", "prec")), ("tas", "humidity"))


@query("b3_crop_bbox", f"SELECT scenario, lat, lon, count(*) AS n FROM ({OBS_SQL}) WHERE lat BETWEEN -25 AND -15 AND lon BETWEEN 295 AND 305 GROUP BY ALL")
def _(s, d):
    return P.crop_bbox(obs(s, d), -25, -15, 295, 305).groupBy("scenario", "lat", "lon").agg(F.count("*").alias("n"))


@query("b4_slice_time", f"SELECT scenario, min(time) AS first_day, max(time) AS last_day, count(*) AS n FROM ({OBS_SQL}) WHERE time BETWEEN DATE '1996-03-01' AND DATE '1998-02-28' GROUP BY ALL")
def _(s, d):
    import datetime

    cut = P.slice_time(obs(s, d), datetime.date(1996, 3, 1), datetime.date(1998, 2, 28), "time")
    return cut.groupBy("scenario").agg(F.min("time").alias("first_day"), F.max("time").alias("last_day"), F.count("*").alias("n"))


_LEV = f"SELECT scenario, tas, CASE WHEN pft <= 2 THEN NULL ELSE pft * 100.0 END AS lev FROM ({OBS_SQL})"


@query("b5_select_level", f"SELECT scenario, 500.0::DOUBLE AS lev, count(*) AS n, avg(tas) AS tas FROM ({_LEV}) WHERE lev = 500 OR lev IS NULL GROUP BY scenario", "tas")
def _(s, d):
    o = obs(s, d).select("scenario", "tas", F.when(F.col("pft") > 2, F.col("pft") * 100.0).alias("lev"))
    return P.select_level(o, 500).groupBy("scenario", "lev").agg(F.count("*").alias("n"), F.avg("tas").alias("tas"))


@query("b6_select_scenarios", f"SELECT scenario, CASE scenario WHEN 'rcp_r' THEN 1 ELSE 2 END AS ord, count(*) AS n FROM ({OBS_SQL}) WHERE scenario IN ('rcp_r', 'rcp_a') GROUP BY ALL")
def _(s, d):
    return P.select_scenarios(obs(s, d), ["rcp_r", "rcp_a"]).groupBy("scenario", "ord").agg(F.count("*").alias("n"))


@query("b7_rename_vars", f"SELECT scenario, avg(tas) AS temp, max(tasmax) AS tmax FROM ({OBS_SQL}) GROUP BY ALL", "temp tmax")
def _(s, d):
    return P.rename_vars(obs(s, d), {"tas": "temp", "tasmax": "tmax"}).groupBy("scenario").agg(F.avg("temp").alias("temp"), F.max("tmax").alias("tmax"))


_NAMES = "SELECT DISTINCT CASE l_linenumber % 4 WHEN 0 THEN 'PRECC,PRECL' WHEN 1 THEN 'Z3,PS' WHEN 2 THEN 'U' ELSE l_linestatus END AS name FROM lineitem"


@query("b8_original_name", f"SELECT name, CASE WHEN name = 'PRECC,PRECL' THEN 'PRECT' ELSE regexp_replace(name, ',PS$', '') END AS original FROM ({_NAMES})")
def _(s, d):
    n = F.col("l_linenumber") % 4
    name = F.when(n == 0, "PRECC,PRECL").when(n == 1, "Z3,PS").when(n == 2, "U").otherwise(F.col("l_linestatus"))
    return table(s, d, "lineitem").select(name.alias("name")).distinct().withColumn("original", S.original_name(F.col("name")))


_UNITS = f"SELECT *, CASE WHEN member < 2 THEN 'kg m-2 s-1' ELSE 'm/s' END AS units FROM ({OBS_SQL})"


def _units(s, d):
    return obs(s, d).withColumn("units", F.when(F.col("member") < 2, "kg m-2 s-1").otherwise("m/s"))


@query("b9_convert_flux", f"""SELECT scenario, member, avg(CASE WHEN units = 'kg m-2 s-1' THEN prec * 0.001 ELSE prec END) AS prec,
    avg(CASE WHEN units = 'kg m-2 s-1' THEN prec * 0.000001 ELSE prec END) AS prec_var FROM ({_UNITS}) GROUP BY ALL""", "prec prec_var", 9)
def _(s, d):
    return _units(s, d).groupBy("scenario", "member").agg(
        F.avg(S.convert_flux(F.col("prec"), F.col("units"))).alias("prec"), F.avg(S.convert_flux(F.col("prec"), F.col("units"), 2)).alias("prec_var"))


@query("b10_kelvin_to_celsius", f"SELECT scenario, avg(tas - 273.15) AS tas, max(tasmax - 273.15) AS tasmax FROM ({OBS_SQL}) GROUP BY ALL", "tas tasmax")
def _(s, d):
    return obs(s, d).groupBy("scenario").agg(F.avg(S.kelvin_to_celsius(F.col("tas"))).alias("tas"), F.max(S.kelvin_to_celsius(F.col("tasmax"))).alias("tasmax"))


@query("b11_precip_mm_day", f"SELECT scenario, member, avg(CASE WHEN units = 'm/s' THEN prec * 1e-9 * 86400000 ELSE prec * 1e-9 * 86400 END) AS prec FROM ({_UNITS}) GROUP BY ALL", "prec", 9)
def _(s, d):
    return _units(s, d).groupBy("scenario", "member").agg(F.avg(S.precip_mm_day(F.col("prec") * 1e-9, F.col("units"))).alias("prec"))


@query("b12_affine_convert", f"SELECT scenario, member, month, lat, lon, tas * 1.8 + 32 AS tas, tas_var * 3.24 AS tas_var FROM ({CLIM_SQL})", "tas tas_var")
def _(s, d):
    c = monthly_climatology(monthly(s, d), ("tas",)).drop("n")
    return P.affine_convert(c, {"tas": (1.8, 32.0)})


@query("b13_suffixes", f"SELECT scenario, member, month, lat, lon, tas_var AS tas_spread, n FROM ({CLIM_SQL})", "tas_spread")
def _(s, d):
    v = P.filter_suffix(monthly_climatology(monthly(s, d), ("tas",)), "_var")
    return P.add_suffix(P.remove_suffix(v, "_var"), ["tas"], "_spread")


@query("b14_split_combine", f"SELECT scenario, member, month, lat, lon, tas, tas_var, prec, prec_var FROM ({CLIM_SQL})", "tas tas_var prec prec_var")
def _(s, d):
    c = monthly_climatology(monthly(s, d), ("tas", "prec")).drop("n")
    return P.combine_mean_var(*P.split_mean_var(c), ["scenario", "member", "month", "lat", "lon"])


@query("b15_drop_aux", f"SELECT scenario, member, month, lat, lon, tas, n FROM ({CLIM_SQL})", "tas")
def _(s, d):
    return P.drop_aux(monthly_climatology(monthly(s, d), ("tas",)))


@query("b16_nan_to_zero", f"SELECT scenario, member, month, lat, lon, coalesce(tas_var, 0) AS tas_var FROM ({CLIM_SQL})", "tas_var")
def _(s, d):
    c = monthly_climatology(monthly(s, d), ("tas",))
    return c.select("scenario", "member", "month", "lat", "lon", F.coalesce("tas_var", F.lit(0.0)).alias("tas_var"))


@query("b17_threshold_mask", f"SELECT {MKEYS}, CASE WHEN prec / 10 * 100 >= 50 THEN prec / 10 * 100 END AS share FROM ({MONTHLY_SQL})", "share")
def _(s, d):
    return monthly(s, d).select("scenario", "member", "year", "month", "lat", "lon", S.threshold_mask(F.col("prec") / 10 * 100, 50.0).alias("share"))


@query("b18_mask_by_grid", f"SELECT {MKEYS}, CASE WHEN code = 1 THEN tas END AS tas FROM ({MONTHLY_SQL}) JOIN ({ZONES_SQL}) USING (lat, lon)", "tas")
def _(s, d):
    m = monthly(s, d).select("scenario", "member", "year", "month", "lat", "lon", "tas")
    return P.mask_by_grid(m, zones(s, d).where("code = 1"), ["tas"])


@query("b20_clamp", f"SELECT scenario, member, month, lat, lon, greatest(least(tas_var, 20.0), 5.0) AS tas_var FROM ({CLIM_SQL}) WHERE tas_var IS NOT NULL UNION ALL SELECT scenario, member, month, lat, lon, NULL FROM ({CLIM_SQL}) WHERE tas_var IS NULL", "tas_var")
def _(s, d):
    c = monthly_climatology(monthly(s, d), ("tas",))
    return c.select("scenario", "member", "month", "lat", "lon", S.clamp(F.col("tas_var"), 5.0, 20.0).alias("tas_var"))


@query("b21_near_zero_mask", f"SELECT {MKEYS}, CASE WHEN abs(prec) > 1e-12 THEN prec END AS prec FROM ({MONTHLY_SQL})", "prec")
def _(s, d):
    return monthly(s, d).select("scenario", "member", "year", "month", "lat", "lon", S.near_zero_mask(F.col("prec")).alias("prec"))


@query("b22_longitudes", f"""SELECT lon, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS signed, CASE WHEN lon - 360 < 0 THEN lon - 360 + 360 ELSE lon - 360 END AS back,
    (SELECT max(lon < 0) FROM ({OBS_SQL})) AS is_signed, count(*) AS n FROM ({OBS_SQL}) GROUP BY lon""")
def _(s, d):
    o = obs(s, d)
    g = o.groupBy("lon").agg(F.count("*").alias("n"))
    flag = P.lon_is_signed(o).select(F.col("signed").alias("is_signed"))
    return g.select("lon", S.lon_to_180(F.col("lon")).alias("signed"), S.lon_to_360(F.col("lon") - 360).alias("back"), "n").crossJoin(F.broadcast(flag))


@query("b23_canonical_names", f"SELECT lat, lon, avg(tas) AS tas FROM ({OBS_SQL}) GROUP BY ALL", "tas")
def _(s, d):
    o = obs(s, d).withColumnsRenamed({"lat": "Latitude", "lon": "nav_lon"})
    return P.canonical_names(o).groupBy("lat", "lon").agg(F.avg("tas").alias("tas"))


@query("b24_scenario_label", "SELECT r_name, substring(label, 1, 6) AS rcp, substring(label, 8) AS landuse, count(*) AS n FROM (SELECT r_name, 'RCP' || (r_regionkey + 2) || '.6_' || CASE r_regionkey % 2 WHEN 0 THEN 'WEG' ELSE 'SEG' END AS label FROM region) GROUP BY ALL")
def _(s, d):
    label = F.concat(F.lit("RCP"), (F.col("r_regionkey") + 2).cast("string"), F.lit(".6_"), F.when(F.col("r_regionkey") % 2 == 0, "WEG").otherwise("SEG"))
    return table(s, d, "region").groupBy("r_name", F.substring(label, 1, 6).alias("rcp"), F.substring(label, 8, 100).alias("landuse")).agg(F.count("*").alias("n"))


@query("b25_recode", f"SELECT code, CASE WHEN name IN ('AMERICA', 'ASIA') THEN name END AS name, count(*) AS n FROM ({OBS_SQL}) JOIN ({ZONES_SQL}) USING (lat, lon) LEFT JOIN ({ZONE_NAMES_SQL}) USING (code) GROUP BY ALL")
def _(s, d):
    o = obs(s, d).join(zones(s, d), ["lat", "lon"])
    return P.recode(o, zone_names(s, d), names=["AMERICA", "ASIA"]).groupBy("code", "name").agg(F.count("*").alias("n"))


@query("b26_drop_first_if_odd", f"""SELECT scenario, member, year, month, tas FROM (SELECT *, count(*) OVER (PARTITION BY scenario, member) AS n, row_number() OVER (PARTITION BY scenario, member ORDER BY year * 100 + month) AS r
    FROM (SELECT scenario, member, year, month, avg(tas) AS tas FROM ({OBS_SQL}) GROUP BY ALL)) WHERE n % 2 = 0 OR r > 1""", "tas")
def _(s, d):
    m = obs(s, d).groupBy("scenario", "member", "year", "month").agg(F.avg("tas").alias("tas")).withColumn("ym", F.col("year") * 100 + F.col("month"))
    return P.drop_first_if_odd(m, ["scenario", "member"], "ym").drop("ym")


@query("b27_year_month", f"SELECT year(time) AS year, month(time) AS month, avg(tas) AS tas FROM ({OBS_SQL}) GROUP BY ALL", "tas")
def _(s, d):
    return obs(s, d).groupBy(F.year("time").alias("year"), F.month("time").alias("month")).agg(F.avg("tas").alias("tas"))


@query("b28_cell_centers", f"""SELECT i, j, lat, lon, count(*) AS n FROM (SELECT i, j, avg((nn + ss) / 2) OVER (PARTITION BY i) AS lat, avg((ee + ww) / 2) OVER (PARTITION BY j) AS lon FROM
    (SELECT CAST((lat + 30) / 5 AS INT) AS i, CAST((lon - 290) / 5 AS INT) AS j, lat + 2.5 AS nn, lat - 2.5 AS ss, lon + 2.5 AS ee, lon - 2.5 AS ww FROM ({OBS_SQL}))) GROUP BY ALL""", "lat lon")
def _(s, d):
    e = obs(s, d).select(((F.col("lat") + 30) / 5).cast("int").alias("i"), ((F.col("lon") - 290) / 5).cast("int").alias("j"),
                         (F.col("lat") + 2.5).alias("nn"), (F.col("lat") - 2.5).alias("ss"), (F.col("lon") + 2.5).alias("ee"), (F.col("lon") - 2.5).alias("ww"))
    return P.cell_centers(e, "nn", "ss", "ee", "ww", "i", "j").groupBy("i", "j", "lat", "lon").agg(F.count("*").alias("n"))


SEASON_SQL = "CASE WHEN month IN (12, 1, 2) THEN 'DJF' WHEN month <= 5 THEN 'MAM' WHEN month <= 8 THEN 'JJA' ELSE 'SON' END"


@query("b29_to_season", f"SELECT scenario, member, {SEASON_SQL} AS season, lat, lon, avg(tas) AS tas, avg(tas_var) AS tas_var FROM ({CLIM_SQL}) GROUP BY ALL", "tas tas_var")
def _(s, d):
    c = monthly_climatology(monthly(s, d), ("tas",))
    return c.groupBy("scenario", "member", S.season(F.col("month")).alias("season"), "lat", "lon").agg(F.avg("tas").alias("tas"), F.avg("tas_var").alias("tas_var"))


@query("b30_stack_vars", f"SELECT scenario, lat, lon, variable, value FROM (UNPIVOT (SELECT scenario, lat, lon, avg(tas) AS tas, avg(prec) AS prec FROM ({OBS_SQL}) GROUP BY ALL) ON tas, prec INTO NAME variable VALUE value)", "value")
def _(s, d):
    g = obs(s, d).groupBy("scenario", "lat", "lon").agg(F.avg("tas").alias("tas"), F.avg("prec").alias("prec"))
    return P.stack_vars(g, ["scenario", "lat", "lon"], ["tas", "prec"])


@query("b30_spread_vars", f"SELECT lat, lon, max(tas) FILTER (scenario = 'rcp_a') AS rcp_a, max(tas) FILTER (scenario = 'rcp_n') AS rcp_n, max(tas) FILTER (scenario = 'rcp_r') AS rcp_r FROM (SELECT scenario, lat, lon, avg(tas) AS tas FROM ({OBS_SQL}) GROUP BY ALL) GROUP BY ALL", "rcp_a rcp_n rcp_r")
def _(s, d):
    g = obs(s, d).groupBy("scenario", "lat", "lon").agg(F.avg("tas").alias("value"))
    return P.spread_vars(g, ["lat", "lon"], "scenario", ["rcp_a", "rcp_n", "rcp_r"])


@query("b31_tag_attrs", f"SELECT variable, CASE variable WHEN 'tas' THEN 'K' ELSE NULL END AS units, CASE variable WHEN 'tas' THEN 'air temperature' ELSE NULL END AS long_name, count(value) AS n FROM (UNPIVOT ({MONTHLY_SQL}) ON tas, prec INTO NAME variable VALUE value) GROUP BY ALL")
def _(s, d):
    long = P.stack_vars(monthly(s, d), ["scenario"], ["tas", "prec"])
    return P.tag_attrs(long, io.variable_meta(s, [("tas", "K", "air temperature")])).groupBy("variable", "units", "long_name").agg(F.count("value").alias("n"))


@query("b32_to_table", f"SELECT scenario, member, month, lat, lon, tas_var, prec_var FROM ({CLIM_SQL}) WHERE tas_var IS NOT NULL OR prec_var IS NOT NULL", "tas_var prec_var")
def _(s, d):
    c = monthly_climatology(monthly(s, d), ("tas", "prec")).select("scenario", "member", "month", "lat", "lon", "tas_var", "prec_var")
    return P.to_table(c, ["tas_var", "prec_var"])


# Scalar functions over monthly fields.
_C = "(tas - 273.15)"
_ES = "((6.1078 * exp(17.3 * (tasmax - 273.15) / (237.3 + tasmax - 273.15)) + 6.1078 * exp(17.3 * (tasmin - 273.15) / (237.3 + tasmin - 273.15))) / 2)"
_Z = "(50 * (lat + 30))"
PRES_SQL = f"(1013.25 * exp(-1.602769777072154 * ln((exp({_Z} / 10000) * 213.15 + 75) / 288.15)))"
_E = f"(sphum / (1 - sphum) * {PRES_SQL} / (0.622 + sphum / (1 - sphum)))"


def crop_climate(df):
    """Pressure, humidity and vapour pressure deficit of rows with tasmax, tasmin (K), sphum and lat (height 50 m a degree from -30)."""
    p = S.pressure_from_height(50 * (F.col("lat") + 30))
    es = S.mean_saturation_vp(S.kelvin_to_celsius(F.col("tasmax")), S.kelvin_to_celsius(F.col("tasmin")))
    e = S.vapour_pressure(F.col("sphum"), p)
    return df.withColumns({"pres": p, "es": es, "r": S.mixing_ratio(F.col("sphum")), "e": e, "rh": S.rel_humidity(e, es), "vpd": S.vpd(es, e)})


@query("h1_pressure_from_height", f"SELECT DISTINCT lat, {PRES_SQL} AS pres FROM ({OBS_SQL})", "pres")
def _(s, d):
    return obs(s, d).select("lat", S.pressure_from_height(50 * (F.col("lat") + 30)).alias("pres")).distinct()


@query("h2_saturation_vp", f"SELECT {MKEYS}, {_ES} AS es FROM ({MONTHLY_SQL})", "es")
def _(s, d):
    return crop_climate(monthly(s, d)).select("scenario", "member", "year", "month", "lat", "lon", "es")


@query("h3_humidity", f"SELECT {MKEYS}, sphum / (1 - sphum) AS r, {_E} AS e, 100 * {_E} / {_ES} AS rh FROM ({MONTHLY_SQL})", "r e rh")
def _(s, d):
    return crop_climate(monthly(s, d)).select("scenario", "member", "year", "month", "lat", "lon", "r", "e", "rh")


@query("h4_vpd", f"SELECT {MKEYS}, greatest({_ES} - {_E}, 0) AS vpd FROM ({MONTHLY_SQL})", "vpd")
def _(s, d):
    return crop_climate(monthly(s, d)).select("scenario", "member", "year", "month", "lat", "lon", "vpd")


def sine_sql(tmin: str, tmax: str, t0: str) -> str:
    """The mean over 200 samples, as SQL."""
    return f"(list_sum(list_transform(range(200), lambda k: greatest(({tmax} + {tmin}) / 2 + ({tmax} - {tmin}) / 2 * sin(2 * pi() * k / 200) - {t0}, 0))) / 200)"


@query("h5_sine_degree_days", f"SELECT {MKEYS}, {sine_sql('(tasmin - 273.15)', '(tasmax - 273.15)', '20')} AS dd FROM ({MONTHLY_SQL})", "dd")
def _(s, d):
    dd = S.sine_degree_days(S.kelvin_to_celsius(F.col("tasmin")), S.kelvin_to_celsius(F.col("tasmax")), F.lit(20.0))
    return monthly(s, d).select("scenario", "member", "year", "month", "lat", "lon", dd.alias("dd"))


AREA_SQL = f"(2 * pi() * 6356.7523 * 5 / 360 * 2 * pi() * 6378.137 * cos(radians(lat)) * 5 / 360)"


@query("h6_pixel_area", f"SELECT DISTINCT lat, lon, {AREA_SQL} AS area FROM ({OBS_SQL})", "area")
def _(s, d):
    return obs(s, d).select("lat", "lon", S.pixel_area(F.col("lat"), F.lit(5.0), F.lit(5.0)).alias("area")).distinct()


def pvalue_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t from gamma functions, as SQL."""
    th = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({th}) * list_sum(list_transform(range(0, CAST({df} AS BIGINT) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos({th}), 2 * k)))"
    odd = f"2 / pi() * ({th} + CASE WHEN {df} > 1 THEN sin({th}) * cos({th}) * list_sum(list_transform(range(0, greatest((CAST({df} AS BIGINT) - 1) // 2, 1)), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(cos({th}), 2 * k))) ELSE 0 END)"
    return f"CASE WHEN ({t}) IS NOT NULL AND ({df}) IS NOT NULL THEN greatest(least(1 - CASE WHEN CAST({df} AS BIGINT) % 2 = 0 THEN {even} ELSE {odd} END, 1), 0) END"


@query("h9_student_t_pvalue", f"SELECT scenario, member, month, lat, lon, n, {pvalue_sql('(tas_var - 15) / 5', '(n + 1)')} AS p FROM ({CLIM_SQL})", "p")
def _(s, d):
    c = monthly_climatology(monthly(s, d), ("tas",))
    return c.select("scenario", "member", "month", "lat", "lon", "n", S.student_t_pvalue((F.col("tas_var") - 15) / 5, (F.col("n") + 1).cast("int")).alias("p"))


@query("h10_normal_quantile", f"SELECT scenario, avg(tas) + {S.normal_quantile(0.975)} * stddev_samp(tas) AS upper FROM ({OBS_SQL}) GROUP BY ALL", "upper")
def _(s, d):
    return obs(s, d).groupBy("scenario").agg((F.avg("tas") + S.normal_quantile(0.975) * F.stddev_samp("tas")).alias("upper"))


@query("h11_percent_diff", f"SELECT lat, lon, 100 * (a - b) / nullif(b, 0) AS perc FROM (SELECT lat, lon, avg(tas) FILTER (scenario = 'rcp_a') AS a, avg(tas) FILTER (scenario = 'rcp_n') AS b FROM ({OBS_SQL}) GROUP BY ALL)", "perc")
def _(s, d):
    at = lambda x: F.avg(F.when(F.col("scenario") == x, F.col("tas")))
    return obs(s, d).groupBy("lat", "lon").agg(S.percent_diff(at("rcp_a"), at("rcp_n")).alias("perc"))


_NL = "(year(time) * 365 + dayofyear(time) - CASE WHEN dayofyear(make_date(year(time), 12, 31)) = 366 AND dayofyear(time) >= 60 THEN 1 ELSE 0 END - 1)"


@query("h12_noleap_days", f"""SELECT time, CAST(dayofyear(time) AS INT) AS doy, CAST(day_no AS BIGINT) AS day_no, CAST(make_date(CAST(later // 365 AS INT), 1, 1) + CAST(later % 365 + CASE WHEN (later // 365) % 4 = 0 AND later % 365 >= 59 THEN 1 ELSE 0 END AS INT) AS DATE) AS later
    FROM (SELECT DISTINCT time, {_NL} AS day_no, {_NL} + 45 AS later FROM ({OBS_SQL}))""")
def _(s, d):
    t = obs(s, d).select("time").distinct()
    return t.select("time", F.dayofyear("time").alias("doy"), S.noleap_day(F.col("time")).alias("day_no"), S.noleap_add_days(F.col("time"), 45).alias("later"))


@query("h13_text", f"SELECT lpad(CAST(month AS VARCHAR), 2, '0') AS mm, split_part(scenario, '_', 1) AS head, regexp_replace(scenario, '_[a-z]$', '') AS stem, printf('%.2f', count(*) / 7.0) AS shown FROM ({OBS_SQL}) GROUP BY scenario, month")
def _(s, d):
    g = obs(s, d).groupBy("scenario", "month").agg(F.count("*").alias("n"))
    return g.select(F.lpad(F.col("month").cast("string"), 2, "0").alias("mm"), F.split_part("scenario", F.lit("_"), F.lit(1)).alias("head"),
                    F.regexp_replace("scenario", "_[a-z]$", "").alias("stem"), F.format_string("%.2f", F.col("n") / 7.0).alias("shown"))


CAL_SQL = f"SELECT DISTINCT lat, lon, CAST(260 + (lat + 30) * 2 AS INT) AS plant_doy, CAST(((lon - 290) * 8 + 20) AS INT) AS harvest_doy FROM ({OBS_SQL})"
CALIDX_SQL = f"SELECT *, p AS plan, CASE WHEN h - p < 90 THEN p + 90 ELSE h END - 1 AS harv FROM (SELECT *, CASE WHEN plant_doy < 213 THEN plant_doy + 365 ELSE plant_doy END AS p, CASE WHEN harvest_doy < 213 THEN harvest_doy + 365 ELSE harvest_doy END AS h FROM ({CAL_SQL}))"


def calendar(s, d):
    return obs(s, d).select("lat", "lon", (260 + (F.col("lat") + 30) * 2).cast("int").alias("plant_doy"), ((F.col("lon") - 290) * 8 + 20).cast("int").alias("harvest_doy")).distinct()


@query("h14_calendar_index", f"SELECT lat, lon, plant_doy, harvest_doy, plan, harv FROM ({CALIDX_SQL})")
def _(s, d):
    return SE.calendar_index(calendar(s, d))


@query("h15_fixed_calendar", f"SELECT lat, lon, CASE WHEN ref IS NOT NULL THEN 274 END AS plant_doy, CASE WHEN ref IS NOT NULL THEN 46 END AS harvest_doy FROM (SELECT lat, lon, CASE WHEN harvest_doy > 100 THEN harvest_doy END AS ref FROM ({CAL_SQL}))")
def _(s, d):
    ref = calendar(s, d).select("lat", "lon", F.when(F.col("harvest_doy") > 100, F.col("harvest_doy")).alias("ref"))
    return SE.fixed_calendar(ref, "ref", 274, 46).drop("ref")


@query("h16_square_term", f"SELECT scenario, member, year, lat, lon, prec * prec AS prec2 FROM ({YEARLY_SQL})", "prec2")
def _(s, d):
    return yearly(s, d).select("scenario", "member", "year", "lat", "lon", (F.col("prec") * F.col("prec")).alias("prec2"))


