"""Aggregations and inference (D, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstats.functions import scalar as S
from gridstats.operators import inference as I
from gridstats.operators import season as SE
from gridstats.operators import stats as ST
from gridstats.operators import trend as T
from gridstats.operators.align import attach_small
from gridstats.plans.joins import _INSIDE as INSIDE_SQL  # noqa: F401
from gridstats.plans.joins import CELLS, CONTROL_SQL, SCELL_SQL, TWO_YEARS_SQL, WINDOW_SQL, YIELD_SQL, linear_predictor, season_days, two_years
from gridstats.plans.registry import query
from gridstats.plans.scan_project import SEASON_SQL, pvalue_sql, sine_sql
from gridstats.sources import io
from gridstats.sources.derived import CLIM_SQL, MONTHLY_SQL, OBS_SQL, YEARLY_SQL, ZONES_SQL, monthly, obs, yearly, zones

CK = "scenario, member, month, lat, lon"
MCELL = ["month", "lat", "lon"]


def clim(s, d):
    return ST.monthly_climatology(monthly(s, d), ("tas", "prec"))


@query("d1_monthly_climatology", f"SELECT {CK}, tas, prec FROM ({CLIM_SQL})", "tas prec")
def _(s, d):
    return clim(s, d).select("scenario", "member", "month", "lat", "lon", "tas", "prec")


@query("d2_monthly_variance", f"SELECT {CK}, tas_var, prec_var, n FROM ({CLIM_SQL})", "tas_var prec_var")
def _(s, d):
    return clim(s, d).select("scenario", "member", "month", "lat", "lon", "tas_var", "prec_var", "n")


@query("d3_daily_to_monthly", f"SELECT scenario, member, year, month, lat, lon, tas, prec FROM ({MONTHLY_SQL})", "tas prec")
def _(s, d):
    return monthly(s, d).select("scenario", "member", "year", "month", "lat", "lon", "tas", "prec")


@query("d4_mean_var_over", f"SELECT scenario, lat, lon, avg(tas) AS tas, avg(prec) AS prec, var_samp(tas) AS tas_var, var_samp(prec) AS prec_var, count(*) AS n FROM ({YEARLY_SQL}) GROUP BY scenario, lat, lon", "tas prec tas_var prec_var")
def _(s, d):
    return ST.mean_var_over(yearly(s, d), ["scenario", "lat", "lon"], ["tas", "prec"])


# A grid with holes: members and cells without some months, one cell without any of a scenario.
HOLES = "scenario = 'rcp_a' AND lat = -10 AND lon = 300 OR scenario = 'rcp_r' AND lon > 300 AND month <= 3 OR member = 2 AND year < 1998"
DENSE_SQL = f"""WITH m AS MATERIALIZED (SELECT * FROM ({MONTHLY_SQL}) WHERE NOT ({HOLES}))
    SELECT s.scenario, mo.month, la.lat, lo.lon, v.tas, v.prec, v.tas_var, v.prec_var, (SELECT count(DISTINCT year) * count(DISTINCT member) FROM m) AS n
    FROM (SELECT DISTINCT scenario FROM m) s, (SELECT DISTINCT month FROM m) mo, (SELECT DISTINCT lat FROM m) la, (SELECT DISTINCT lon FROM m) lo
    LEFT JOIN (SELECT scenario, month, lat, lon, avg(tas) AS tas, avg(prec) AS prec, var_samp(tas) AS tas_var, var_samp(prec) AS prec_var FROM m GROUP BY ALL) v
        ON v.scenario = s.scenario AND v.month = mo.month AND v.lat = la.lat AND v.lon = lo.lon"""


@query("d4_mean_var_dense", DENSE_SQL, "tas prec tas_var prec_var")
def _(s, d):
    return ST.mean_var_over(monthly(s, d).where(f"NOT ({HOLES})"), ["scenario", *MCELL], ["tas", "prec"], dims=["year", "member"])


@query("d4_gaps", f"""WITH m AS MATERIALIZED (SELECT scenario, member, year, lat, lon FROM ({YEARLY_SQL}) WHERE NOT ({HOLES.replace("month <= 3", "year = 1996")}))
    SELECT s.scenario, me.member, y.year, la.lat, lo.lon FROM (SELECT DISTINCT scenario FROM m) s, (SELECT DISTINCT member FROM m) me, (SELECT DISTINCT year FROM m) y, (SELECT DISTINCT lat FROM m) la, (SELECT DISTINCT lon FROM m) lo
    EXCEPT SELECT * FROM m""")
def _(s, d):
    return ST.gaps(yearly(s, d).where("NOT (" + HOLES.replace("month <= 3", "year = 1996") + ")"), ["scenario", "member", "year", "lat", "lon"])


@query("d5_ensemble_mean", f"SELECT scenario, month, lat, lon, avg(tas) AS tas FROM ({CLIM_SQL}) GROUP BY scenario, month, lat, lon", "tas")
def _(s, d):
    return clim(s, d).groupBy("scenario", *MCELL).agg(F.avg("tas").alias("tas"))


# The pooled variance must be the variance of all samples together.
DIRECT_SQL = f"SELECT scenario, month, lat, lon, var_samp(tas) AS tas_var, count(*) AS n FROM ({MONTHLY_SQL}) GROUP BY scenario, month, lat, lon"
POOL_SQL = f"SELECT m.*, v.tas_var, v.n FROM (SELECT scenario, month, lat, lon, avg(tas) AS tas FROM ({CLIM_SQL}) GROUP BY scenario, month, lat, lon) m JOIN ({DIRECT_SQL}) v USING (scenario, month, lat, lon)"


@query("d6_pool_variances", DIRECT_SQL, "tas_var", 5)
def _(s, d):
    c = clim(s, d).withColumn("tas_var", F.coalesce("tas_var", F.when(F.col("n") == 1, 0.0)))
    return c.groupBy("scenario", *MCELL).agg(ST.pooled_variance("tas", "tas_var", "n").alias("tas_var"), F.sum("n").alias("n"))


@query("d7_pool_means", f"SELECT scenario, month, lat, lon, avg(tas) AS tas FROM ({MONTHLY_SQL}) GROUP BY scenario, month, lat, lon", "tas")
def _(s, d):
    return clim(s, d).groupBy("scenario", *MCELL).agg(ST.pooled_mean("tas").alias("tas"))


@query("d8_pool_pair_variance", f"SELECT scenario, month, lat, lon, avg(tas) AS tas, var_samp(tas) AS tas_var FROM ({MONTHLY_SQL}) WHERE member IN (0, 1) GROUP BY scenario, month, lat, lon HAVING count(*) FILTER (member = 0) > 1 AND count(*) FILTER (member = 1) > 1", "tas tas_var", 5)
def _(s, d):
    c = clim(s, d).where("n > 1")
    at = lambda m: c.where(F.col("member") == m).select("scenario", *MCELL, *[F.col(x).alias(f"{x}_{m}") for x in ("tas", "tas_var", "n")])
    v = lambda x: F.col(x)
    return at(0).join(at(1), ["scenario", *MCELL]).select(
        "scenario", *MCELL, ST.pool_pair_mean(v("tas_0"), v("n_0"), v("tas_1"), v("n_1")).alias("tas"),
        ST.pool_pair_variance(v("tas_0"), v("tas_var_0"), v("n_0"), v("tas_1"), v("tas_var_1"), v("n_1")).alias("tas_var"))


@query("d9_ensemble_stats", POOL_SQL, "tas tas_var", 5)
def _(s, d):
    return ST.ensemble_stats(clim(s, d).select("scenario", *MCELL, "tas", "tas_var", "n"), ["scenario", *MCELL], ["tas"])


@query("d10_zonal_mean", f"SELECT scenario, code, month, avg(tas) AS tas FROM ({MONTHLY_SQL}) JOIN ({ZONES_SQL}) USING (lat, lon) GROUP BY scenario, code, month", "tas")
def _(s, d):
    return attach_small(monthly(s, d), zones(s, d), CELLS).groupBy("scenario", "code", "month").agg(F.avg("tas").alias("tas"))


@query("d11_season_mean", f"SELECT scenario, {SEASON_SQL} AS season, lat, lon, avg(tas) AS tas FROM ({CLIM_SQL}) GROUP BY ALL", "tas")
def _(s, d):
    return clim(s, d).groupBy("scenario", S.season(F.col("month")).alias("season"), "lat", "lon").agg(F.avg("tas").alias("tas"))


PFT = (1, 2, 3)


@query("d12_class_sum", f"SELECT scenario, year, lat, lon, coalesce(sum(pct) FILTER (pft IN (1, 2, 3)), 0) AS pct FROM ({OBS_SQL}) GROUP BY scenario, year, lat, lon", "pct")
def _(s, d):
    return ST.class_sum(obs(s, d), ["scenario", "year", "lat", "lon"], "pft", PFT, "pct")


_HOLES = f"SELECT *, CASE WHEN pft <> 4 THEN tas END AS t FROM ({OBS_SQL})"


@query("d13_weighted_mean", f"SELECT scenario, lat, lon, sum(t * weight) / sum(weight) AS t, sum(prec * weight) / sum(weight) AS prec FROM ({_HOLES}) GROUP BY scenario, lat, lon", "t prec")
def _(s, d):
    o = obs(s, d).withColumn("t", F.when(F.col("pft") != 4, F.col("tas")))
    return ST.weighted_mean(o, ["scenario", "lat", "lon"], ["t", "prec"], "weight")


@query("d14_weighted_mean_masked", f"SELECT scenario, lat, lon, sum(t * weight) / sum(CASE WHEN t IS NOT NULL THEN weight END) AS t FROM ({_HOLES}) GROUP BY scenario, lat, lon", "t")
def _(s, d):
    o = obs(s, d).withColumn("t", F.when(F.col("pft") != 4, F.col("tas")))
    return ST.weighted_mean(o, ["scenario", "lat", "lon"], ["t"], "weight", masked=True)


@query("d15_weight_choices", f"SELECT scenario, sum(tas * weight) / sum(weight) AS by_area, sum(tas * weight * prec) / sum(weight * prec) AS by_production, avg(tas) AS plain FROM ({OBS_SQL}) GROUP BY scenario", "by_area by_production plain")
def _(s, d):
    area = F.col("weight")
    return ST.means_by_weights(obs(s, d), ["scenario"], "tas", {"by_area": area, "by_production": area * F.col("prec"), "plain": None})


@query("d16_group_totals", f"SELECT scenario, year, sum(weight) AS area, sum(weight * prec) AS production, avg(weight) AS mean_area FROM ({OBS_SQL}) GROUP BY scenario, year", "area production mean_area", 2)
def _(s, d):
    return obs(s, d).groupBy("scenario", "year").agg(F.sum("weight").alias("area"), F.sum(F.col("weight") * F.col("prec")).alias("production"), F.avg("weight").alias("mean_area"))


@query("d17_envelope", f"SELECT scenario, year, avg(tas) AS mean, min(tas) AS low, max(tas) AS high FROM (SELECT scenario, member, year, avg(tas) AS tas FROM ({OBS_SQL}) GROUP BY ALL) GROUP BY ALL", "mean low high")
def _(s, d):
    m = obs(s, d).groupBy("scenario", "member", "year").agg(F.avg("tas").alias("tas"))
    return ST.envelope(m, ["scenario", "year"], "tas")


YK = "scenario, member, year, lat, lon"


@query("d18_multi_model_mean", f"SELECT {YK}, model, yield FROM ({YIELD_SQL}) UNION ALL SELECT {YK}, 'Ensemble', avg(yield) FROM ({YIELD_SQL}) GROUP BY {YK}", "yield")
def _(s, d):
    y = linear_predictor(s, d).withColumn("yield", F.exp("eta"))
    return ST.with_multi_model_mean(y, ["scenario", "member", "year", "lat", "lon"], ["yield"], "model")


_MEANS19 = ", ".join(f"avg({c}) FILTER (inside) AS {c}mean" for c in ("temp", "tmin", "tmax", "prec", "vpd", "trng"))
ORACLE_D19 = f"SELECT scenario, lat, lon, {_MEANS19}, max(harv - plan) AS ndays FROM ({TWO_YEARS_SQL}) GROUP BY scenario, lat, lon HAVING count(temp) FILTER (day_idx = 1) > 0"
INDEX_NAMES = ["temp", "tmin", "tmax", "prec", "vpd", "trng"]


def first_day():
    """The temperature of the tables' first day, the 2nd of January 1995."""
    return F.when(F.col("day_idx") == 1, F.col("temp"))


@query("d19_season_means", ORACLE_D19, " ".join(f"{c}mean" for c in INDEX_NAMES))
def _(s, d):
    return SE.season_means(two_years(s, d), ["scenario", "lat", "lon"], INDEX_NAMES, SE.in_window(), first_day())


GDD_SQL = f"SELECT scenario, lat, lon, CAST(tmp AS DOUBLE) AS tmp, sum({sine_sql('tmin', 'tmax', 'tmp')}) AS tempgdds FROM ({WINDOW_SQL}), (SELECT unnest(range(10, 32)) AS tmp) GROUP BY scenario, lat, lon, tmp"


def gdds(s, d):
    return SE.degree_days(season_days(s, d), ["scenario", "lat", "lon"])


@query("d20_growing_degree_days", GDD_SQL, "tempgdds", 5)
def _(s, d):
    return gdds(s, d)


@query("d21_temperature_exposure", f"""SELECT scenario, lat, lon, CAST(tmp AS DOUBLE) AS tmp, sum(list_sum(list_transform(range(200), lambda k: CASE WHEN (tmax + tmin) / 2 + (tmax - tmin) / 2 * sin(2 * pi() * k / 200) BETWEEN tmp - 1e-9 AND tmp + 1 + 1e-9 THEN 1.0 ELSE 0.0 END)) / 200) AS exposure
    FROM ({WINDOW_SQL}), (SELECT unnest([15, 20, 25]) AS tmp) GROUP BY scenario, lat, lon, tmp""", "exposure", 5)
def _(s, d):
    return SE.degree_days(season_days(s, d), ["scenario", "lat", "lon"], thresholds=(15, 20, 25), exposure=True)


ORACLE_D22 = f"SELECT scenario, lat, lon, max(CASE WHEN tmp = 30 THEN tempgdds END) AS edd, max(CASE WHEN tmp = 10 THEN tempgdds END) - max(CASE WHEN tmp = 30 THEN tempgdds END) AS gdd FROM ({GDD_SQL}) GROUP BY ALL"


@query("d22_gdd_edd", ORACLE_D22, "edd gdd", 5)
def _(s, d):
    return SE.gdd_edd(SE.degree_days(season_days(s, d), ["scenario", "lat", "lon"], thresholds=(10, 30)), ["scenario", "lat", "lon"])


_MISS = f"SELECT scenario, lat, lon, year, CASE WHEN (year + CAST(lat AS INT)) % 4 = 0 AND scenario = 'rcp_a' OR scenario = 'rcp_n' AND lon > 300 AND year < 1999 THEN NULL ELSE tas END AS tas FROM (SELECT scenario, lat, lon, year, avg(tas) AS tas FROM ({OBS_SQL}) GROUP BY ALL)"


@query("d23_trend_slope", f"SELECT scenario, lat, lon, CASE WHEN count(*) - count(tas) <= 3 THEN regr_slope(tas, year) END AS tas FROM ({_MISS}) GROUP BY scenario, lat, lon", "tas")
def _(s, d):
    g = obs(s, d).groupBy("scenario", "lat", "lon", "year").agg(F.avg("tas").alias("tas"))
    gone = ((F.pmod(F.col("year") + F.col("lat").cast("int"), F.lit(4)) == 0) & (F.col("scenario") == "rcp_a")) | ((F.col("scenario") == "rcp_n") & (F.col("lon") > 300) & (F.col("year") < 1999))
    return T.trend_slope(g.withColumn("tas", F.when(~gone, F.col("tas"))), ["scenario", "lat", "lon"], "year", ["tas"])


_STEP = "xor({0}, {0} >> {1}) * {2} % 2147483648"
BOOT_SQL = f"""WITH g AS MATERIALIZED (SELECT scenario, lat, lon, list(struct_pack(x := year - mid, y := tas) ORDER BY year, tas) AS p, count(*) AS n FROM (SELECT *, avg(year) OVER (PARTITION BY scenario, lat, lon) AS mid FROM
        (SELECT scenario, lat, lon, year, avg(tas) AS tas FROM ({OBS_SQL}) GROUP BY ALL)) GROUP BY ALL),
    c AS (SELECT *, unnest(range(1, n + 1)) AS i FROM (SELECT *, CAST('0x' || substr(md5(concat_ws('|', scenario, lat, lon)), 1, 7) AS BIGINT) + 1 AS s, unnest(range(500)) AS r FROM g)),
    x AS (SELECT * EXCLUDE x, {_STEP.format('x', 13, 1566083941)} AS x FROM (SELECT * EXCLUDE x, {_STEP.format('x', 15, 1812433253)} AS x FROM (SELECT *, (s * 1640531527 + r * 1013904223 + i * 1664525) % 2147483648 AS x FROM c))),
    draws AS (SELECT scenario, lat, lon, r, p[((xor(x, x >> 16) * n) >> 31) + 1] AS v FROM x),
    slopes AS (SELECT scenario, lat, lon, r, count(*) AS k, sum(v.x) AS sx, sum(v.y) AS sy, sum(v.x * v.x) AS sxx, sum(v.x * v.y) AS sxy FROM draws GROUP BY ALL),
    b AS (SELECT scenario, lat, lon, CASE WHEN abs(k * sxx - sx * sx) > 1e-9 THEN (k * sxy - sx * sy) / (k * sxx - sx * sx) END AS b FROM slopes)
    SELECT scenario, lat, lon, CASE WHEN count(b) = count(*) THEN avg(b) END AS tas, CASE WHEN count(b) = count(*) THEN var_pop(b) END AS tas_var FROM b GROUP BY scenario, lat, lon"""


@query("d24_trend_bootstrap", BOOT_SQL, "tas tas_var")
def _(s, d):
    g = obs(s, d).groupBy("scenario", "lat", "lon", "year").agg(F.avg("tas").alias("tas"))
    return T.trend_bootstrap(g, ["scenario", "lat", "lon"], "year", "tas", nsamp=500)


@query("d25_regression_summary", f"""SELECT scenario, lat, n, slope, intercept, r2, pvalue, printf('y = %.3f x + %.3f; R2 = %.2f; p %s', slope, intercept, r2, CASE WHEN pvalue <= 0.05 THEN '<0.05' ELSE printf('= %.2f', pvalue) END) AS equation FROM
    (SELECT *, {pvalue_sql('sqrt(r2 * (n - 2) / (1 - r2))', '(n - 2)')} AS pvalue FROM (SELECT scenario, lat, CAST(regr_count(tas, prec) AS BIGINT) AS n, regr_slope(tas, prec) AS slope, regr_intercept(tas, prec) AS intercept, regr_r2(tas, prec) AS r2 FROM ({SCELL_SQL}) GROUP BY ALL))""", "slope intercept r2 pvalue")
def _(s, d):
    g = ST.mean_var_over(obs(s, d), ["scenario", "lat", "lon"], ["tas", "prec"])
    return T.regression_summary(g, ["scenario", "lat"], "prec", "tas")


@query("d26_bias", f"SELECT lat, lon, h.tas - o.tas AS bias FROM (SELECT lat, lon, avg(tas) AS tas FROM ({OBS_SQL}) WHERE scenario <> 'rcp_n' AND year <= 1997 GROUP BY ALL) h JOIN (SELECT lat, lon, avg(tas) AS tas FROM ({OBS_SQL}) WHERE scenario = 'rcp_n' AND year <= 1997 GROUP BY ALL) o USING (lat, lon)", "bias")
def _(s, d):
    past = obs(s, d).where("year <= 1997")
    m = past.where("scenario <> 'rcp_n'").groupBy("lat", "lon").agg(F.avg("tas").alias("m"))
    o = past.where("scenario = 'rcp_n'").groupBy("lat", "lon").agg(F.avg("tas").alias("o"))
    return m.join(o, CELLS).select("lat", "lon", (F.col("m") - F.col("o")).alias("bias"))


@query("d27_symmetric_limit", f"SELECT max(abs(tas)) AS lim FROM ({CONTROL_SQL})", "lim")
def _(s, d):
    from gridstats.operators.align import control_diff
    from gridstats.plans.joins import by_scenario, pair_table

    return ST.symmetric_limit(control_diff(by_scenario(s, d), pair_table(s), CELLS, ["tas"]), ["tas"]).select(F.col("limit").alias("lim"))


@query("d28_period_mean", f"SELECT scenario, lat, lon, avg(weight) AS price FROM ({OBS_SQL}) WHERE year BETWEEN 1996 AND 1999 GROUP BY scenario, lat, lon", "price", 3)
def _(s, d):
    return io.scan_months(obs(s, d), 1996, 1999, None, "time").groupBy("scenario", "lat", "lon").agg(F.avg("weight").alias("price"))


@query("d29_sum_variables", f"SELECT {CK}, tas + prec + tas_var AS total FROM ({CLIM_SQL})", "total")
def _(s, d):
    return clim(s, d).select("scenario", "member", *MCELL, ST.sum_variables(["tas", "prec", "tas_var"]).alias("total"))


@query("d30_day_count_check", f"SELECT scenario, year, count(DISTINCT time) AS days FROM ({OBS_SQL}) GROUP BY scenario, year HAVING count(DISTINCT time) <> 365")
def _(s, d):
    return ST.short_years(obs(s, d), ["scenario"])


# Inference.
def _p(m1, v1, m2, v2, n1, n2):
    t = f"(({m1}) - ({m2})) / nullif(sqrt((({n1} - 1) * ({v1}) + ({n2} - 1) * ({v2})) / ({n1} + {n2} - 2) * (1.0 / {n1} + 1.0 / {n2})), 0)"
    return pvalue_sql(t, f"({n1} + {n2} - 2)")


SM_SQL = f"SELECT scenario, month, lat, lon, avg(tas) AS tas, var_samp(tas) AS tas_var, avg(prec) AS prec, var_samp(prec) AS prec_var, count(*) AS n FROM ({MONTHLY_SQL}) GROUP BY scenario, month, lat, lon"


def _test_sql(cols: str, n1: str = "28", n2: str = "28", keys: str = "month, lat, lon") -> str:
    return f"SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, {cols} FROM ({SM_SQL}) a JOIN ({SM_SQL}) b USING (month, lat, lon) WHERE a.scenario = 'rcp_a' AND b.scenario = 'rcp_n'"


def by_month(s, d):
    return ST.mean_var_over(monthly(s, d), ["scenario", *MCELL], ["tas", "prec"])


def side(df, name):
    return df.where(F.col("scenario") == name).drop("scenario")


TEST_SQL = _test_sql(f"a.tas - b.tas AS tas, {_p('a.tas', 'a.tas_var', 'b.tas', 'b.tas_var', '28', '28')} AS tas_pval, a.tas_var + b.tas_var AS tas_var")


def delta(s, d, **k):
    return I.diff_ttest_within(by_month(s, d), "scenario", "rcp_a", "rcp_n", MCELL, ["tas"], 28, **k)


@query("i1_diff_ttest", TEST_SQL, "tas tas_pval tas_var")
def _(s, d):
    return delta(s, d)


@query("i2_diff_ttest_perc", _test_sql(f"a.tas - b.tas AS tas, {_p('a.tas', 'a.tas_var', 'b.tas', 'b.tas_var', '28', '28')} AS tas_pval, a.tas_var + b.tas_var AS tas_var, 100 * (a.tas - b.tas) / b.tas AS tas_perc, {_p('a.tas', 'a.tas_var', 'b.tas', 'b.tas_var', '28', '28')} AS tas_perc_pval"), "tas tas_pval tas_var tas_perc tas_perc_pval")
def _(s, d):
    return delta(s, d, percent=True)


@query("i3_diff_ttest_selected", _test_sql(f"500.0::DOUBLE AS lev, a.prec - b.prec AS prec, {_p('a.prec', 'a.prec_var', 'b.prec', 'b.prec_var', '28', '44')} AS prec_pval, a.prec_var + b.prec_var AS prec_var"), "prec prec_pval prec_var")
def _(s, d):
    from gridstats.operators.project import select_level

    m = by_month(s, d).withColumn("lev", F.when(F.col("month") > 0, F.lit(None).cast("double")))
    at = select_level(m, 500.0)
    return I.diff_ttest(side(at, "rcp_a"), side(at, "rcp_n"), [*MCELL, "lev"], ["prec"], 28, 44)


@query("i4_ttest_vs_constant", f"SELECT scenario, lat, lon, {pvalue_sql('(tas - 292) / nullif(sqrt(tas_var / n), 0)', '(2 * n - 2)')} AS p FROM (SELECT scenario, lat, lon, avg(tas) AS tas, var_samp(tas) AS tas_var, count(*) AS n FROM ({YEARLY_SQL}) GROUP BY ALL)", "p")
def _(s, d):
    g = ST.mean_var_over(yearly(s, d), ["scenario", "lat", "lon"], ["tas"])
    return g.select("scenario", "lat", "lon", I.ttest_vs_constant(F.col("tas"), F.col("tas_var"), F.col("n"), 292.0).alias("p"))


SAMPLES_SQL = f"""SELECT a.lat, a.lon, a.m - b.m AS diff, (a.m - b.m) / nullif(sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 0) AS statistic, {_p('a.m', 'a.v', 'b.m', 'b.v', 'a.n', 'b.n')} AS pvalue
    FROM (SELECT lat, lon, avg(tas) AS m, var_samp(tas) AS v, count(*) AS n FROM ({YEARLY_SQL}) WHERE year <= 1997 GROUP BY ALL) a JOIN (SELECT lat, lon, avg(tas) AS m, var_samp(tas) AS v, count(*) AS n FROM ({YEARLY_SQL}) WHERE year >= 1999 GROUP BY ALL) b USING (lat, lon)"""


@query("i5_ttest_samples", SAMPLES_SQL, "diff statistic pvalue")
def _(s, d):
    y = yearly(s, d)
    return I.ttest_samples(y.where("year <= 1997"), y.where("year >= 1999"), CELLS, "tas")


@query("i6_significance_mask", f"SELECT month, lat, lon, CASE WHEN tas_pval <= 0.3 THEN tas END AS tas FROM ({TEST_SQL})", "tas")
def _(s, d):
    return delta(s, d).select(*MCELL, I.significance_mask(F.col("tas"), F.col("tas_pval"), 0.3).alias("tas"))


@query("i7_vector_mask", _test_sql(f"CASE WHEN {_p('a.tas', 'a.tas_var', 'b.tas', 'b.tas_var', '28', '28')} <= 0.2 OR {_p('a.prec', 'a.prec_var', 'b.prec', 'b.prec_var', '28', '28')} <= 0.2 THEN a.tas - b.tas END AS u"), "u")
def _(s, d):
    m = by_month(s, d)
    t = I.diff_ttest(side(m, "rcp_a"), side(m, "rcp_n"), MCELL, ["tas", "prec"], 28)
    return t.select(*MCELL, I.vector_mask(F.col("tas"), F.col("tas_pval"), F.col("prec_pval"), 0.2).alias("u"))


_Z = S.normal_quantile(0.975)


@query("i8_confidence_interval", f"SELECT {CK}, tas - {_Z} * sqrt(tas_var) AS low, tas + {_Z} * sqrt(tas_var) AS high FROM ({CLIM_SQL})", "low high")
def _(s, d):
    low, high = I.confidence_interval(F.col("tas"), F.col("tas_var"))
    return clim(s, d).select("scenario", "member", *MCELL, low.alias("low"), high.alias("high"))


@query("i9_significance_class", f"SELECT month, lat, lon, CAST(CASE WHEN tas_pval IS NULL THEN NULL WHEN tas_pval <= 0.1 THEN 0 WHEN tas_pval <= 0.4 THEN 1 ELSE 2 END AS INT) AS class FROM ({TEST_SQL})")
def _(s, d):
    return delta(s, d).select(*MCELL, I.significance_class(F.col("tas_pval"), (0.1, 0.4)).alias("class"))


@query("i10_scale_trend", f"SELECT scenario, lat, lon, 39 * regr_slope(tas, year) AS change FROM ({YEARLY_SQL}) GROUP BY scenario, lat, lon", "change")
def _(s, d):
    t = T.trend_slope(yearly(s, d), ["scenario", "lat", "lon"], "year", ["tas"])
    return t.select("scenario", "lat", "lon", (39 * F.col("tas")).alias("change"))


@query("ensemble_delta_ttest", f"""SELECT month, lat, lon, a.tas - b.tas AS tas, {_p('a.tas', 'a.tas_var', 'b.tas', 'b.tas_var', '28', '28')} AS tas_pval, CASE WHEN {_p('a.tas', 'a.tas_var', 'b.tas', 'b.tas_var', '28', '28')} <= 0.3 THEN a.tas - b.tas END AS masked
    FROM (SELECT * FROM ({POOL_SQL}) WHERE scenario = 'rcp_a') a JOIN (SELECT * FROM ({POOL_SQL}) WHERE scenario = 'rcp_n') b USING (month, lat, lon)""", "tas tas_pval masked", 5)
def _(s, d):
    """Member climatologies, pooled, against the control scenario, masked by significance."""
    e = ST.ensemble_stats(clim(s, d).select("scenario", *MCELL, "tas", "tas_var", "n"), ["scenario", *MCELL], ["tas"])
    t = I.diff_ttest_within(e, "scenario", "rcp_a", "rcp_n", MCELL, ["tas"], 28)
    return t.select(*MCELL, "tas", "tas_pval", I.significance_mask(F.col("tas"), F.col("tas_pval"), 0.3).alias("masked"))


