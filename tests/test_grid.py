"""Hand-made grids: missing values, ties, leap years, empty groups, and invariants."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
import statistics
from pathlib import Path

import pytest
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
from gridstats.sources import io


def one(df, col):
    return df.select(col).first()[0]


def test_pooled_variance_is_direct_variance(spark):
    rows = [(m, 0.0, float(v)) for m, vs in enumerate(([290, 291, 295], [288, 289, 300], [292, 292.5, 293])) for v in vs]
    df = spark.createDataFrame(rows, "member int, lat double, x double")
    g = ST.mean_var_over(df, ["member", "lat"], ["x"])
    got = ST.ensemble_stats(g, ["lat"], ["x"]).first()
    assert got["x_var"] == pytest.approx(statistics.variance(r[2] for r in rows))
    assert got["n"] == 9


def test_single_observations_and_missing(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (2, None)], "k int, x double")
    got = {r["k"]: r for r in ST.mean_var_over(df, ["k"], ["x"]).collect()}
    assert got[1]["x"] == 5.0 and got[1]["x_var"] is None and got[1]["n"] == 2
    assert got[2]["x"] is None


def test_weighted_means_differ_on_missing(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, None, 3.0)], "k int, x double, w double")
    assert one(ST.weighted_mean(df, ["k"], ["x"], "w"), "x") == 0.5
    assert one(ST.weighted_mean(df, ["k"], ["x"], "w", masked=True), "x") == 2.0


def test_weighted_mean_of_no_weight_is_null(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0)], "k int, x double, w double")
    assert one(ST.weighted_mean(df, ["k"], ["x"], "w"), "x") is None


def integrated_p(t, df, steps=200_000):
    """Two-sided p from the density, by Simpson's rule over [0, t]."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    h = t / steps
    y = [c * (1 + (i * h) ** 2 / df) ** (-(df + 1) / 2) for i in range(steps + 1)]
    return 1 - 2 * h / 3 * (y[0] + y[-1] + 4 * sum(y[1:-1:2]) + 2 * sum(y[2:-1:2]))


@pytest.mark.parametrize(("t", "df"), [(2.0, 10), (1.0, 1), (2.5, 2), (0.0, 7), (3.1, 86), (1.5, 3), (0.4, 117)])
def test_student_p(spark, t, df):
    p = integrated_p(t, df)
    row = spark.range(1).select(S.student_t_pvalue(F.lit(t), df).alias("p"), S.student_t_pvalue(F.lit(-t), F.lit(df)).alias("m")).first()
    assert row["p"] == pytest.approx(p, abs=1e-9)
    assert row["m"] == row["p"]


def test_student_p_at_many_degrees_is_normal(spark):
    p = spark.range(1).select(S.student_t_pvalue(F.lit(1.96), F.lit(10**9)).alias("p")).first()["p"]
    assert p == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-9)


def test_places_without_pairs(spark):
    rows = [(y, n) for y in (3, None, 1, 2) for n in ("b", "a", None)]
    out = P.with_place(spark.createDataFrame(rows, "year int, name string"), "year", "name")
    low = lambda v: (v is not None, v)
    assert [(r["year"], r["name"]) for r in sorted(out.collect(), key=lambda r: r["place"])] == sorted(rows, key=lambda r: (low(r[0]), low(r[1])))
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_axes_and_polygons_meet_without_nested_loops(spark):
    g = spark.createDataFrame([(float(i), float(j), 1.0) for i in range(3) for j in range(3)], "lat double, lon double, x double")
    poly = spark.createDataFrame([(1, [[(-20.5, -20.5), (20.5, -20.5), (20.5, 20.5), (-20.5, 20.5)]], 2.0)], "shape_no int, rings array<array<struct<x:double,y:double>>>, v double")
    raster = A.rasterize(g, poly, "v", tile=3.0)
    assert [r["v"] for r in raster.collect()] == [2.0] * 9
    for out in (A.regrid_nearest(g, g), A.regrid_bilinear(g, g, [], ["x"]), A.snap_join(g, g, []), raster):
        assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_groups_are_resampled_independently(spark):
    rng = random.Random(5)
    series = [(y, rng.random()) for y in range(12)]
    df = spark.createDataFrame([(k, y, v) for k in (1, 2) for y, v in series], "k int, year int, x double")
    a, b = T.trend_bootstrap(df, ["k"], "year", "x").collect()
    assert a["x"] != b["x"]


def test_no_spread_gives_no_test(spark):
    a = spark.createDataFrame([(1, 3.0, 0.0)], "lat int, x double, x_var double")
    assert one(I.diff_ttest(a, a, ["lat"], ["x"], 5), "x_pval") is None


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "lat double, lon double, x double, x_var double")
    assert I.diff_ttest(e, e, ["lat", "lon"], ["x"], 5).count() == 0
    assert ST.envelope(e, ["lat"], "x").count() == 0
    assert A.regrid_nearest(e, e).count() == 0


def test_regrid_to_itself_is_identity(spark):
    g = spark.createDataFrame([(float(a), float(o), float(a * o)) for a in (0, 5, 10) for o in (1, 2)], "lat double, lon double, x double")
    for out in (A.regrid_nearest(g, g).select(*g.columns), A.regrid_bilinear(g, g, [], ["x"]).select(*g.columns)):
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, g.collect()))


def test_bilinear_needs_its_corners(spark):
    g = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 1.0, None), (1.0, 0.0, 3.0), (1.0, 1.0, 4.0)], "lat double, lon double, x double")
    t = spark.createDataFrame([(0.5, 0.5)], "lat double, lon double")
    assert one(A.regrid_bilinear(g, t, [], ["x"]), "x") is None
    assert one(A.regrid_bilinear(g.fillna(2.0), t, [], ["x"]), "x") == 2.5
    far = spark.createDataFrame([(9.0, 0.5)], "lat double, lon double")
    assert A.regrid_bilinear(g, far, [], ["x"]).count() == 0


def test_square_on_a_grid(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    poly = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in ring]], 7.0), (2, [[{"x": x, "y": y + 0.5} for x, y in ring]], -9999.0)],
                                 "shape_no int, rings array<array<struct<x:double,y:double>>>, v double")
    cells = spark.createDataFrame([(a / 4 + 0.125, o / 4 + 0.125) for a in range(8) for o in range(8)], "lat double, lon double")
    got = {(r["lat"], r["lon"]): r["v"] for r in A.rasterize(cells, poly, "v").collect()}
    assert len(got) == 64
    assert got[(0.125, 0.125)] == 7.0
    assert got[(0.625, 0.625)] == 0.0  # the later shape wins, and holds the missing value
    assert sum(v == 7.0 for v in got.values()) == 8


def test_ag_years_keep_their_start_in_leap_years(spark):
    days = [(dt.date(1995, 7, 1) + dt.timedelta(days=i), 1.0) for i in range(366 + 200)]
    df = SE.complete_ag_years(spark.createDataFrame(days, "time date, prec double").withColumn("k", F.lit(1)), ["k"])
    assert [tuple(r) for r in df.groupBy("ag_year").agg(F.count("*"), F.max("ag_day")).collect()] == [(1995, 366, 365)]


def test_rainy_season_and_telescoping(spark):
    rain = [0.0] * 100 + [9.0] * 150 + [0.0] * 116
    days = [(1, dt.date(1995, 7, 1) + dt.timedelta(days=i), r) for i, r in enumerate(rain)]
    df = SE.complete_ag_years(spark.createDataFrame(days, "k int, time date, prec double"), ["k"])
    aa = SE.anomalous_accumulation(df, ["k"])
    assert aa.agg(F.sum("daa")).first()[0] == pytest.approx(aa.agg(F.max_by("aa", "ag_day") - F.min_by("aa", "ag_day")).first()[0])
    got = SE.rainy_season(df, ["k"]).first()
    assert (got["outoday"], got["outeday"], got["outslen"]) == (99, 249, 150)
    assert one(SE.steepest_day(aa, ["k"]), "steepest") == 100


def test_no_match_on_day_zero(spark):
    days = [(1, dt.date(1995, 7, 1) + dt.timedelta(days=i), 5.0) for i in range(366)]
    df = SE.complete_ag_years(spark.createDataFrame(days, "k int, time date, prec double"), ["k"])
    got = SE.rainy_season(df, ["k"]).first()
    assert got["outoday"] is None and got["outeday"] == 365 and got["outslen"] is None


def test_calendar_shorter_than_ninety_days(spark):
    got = SE.calendar_index(spark.createDataFrame([(250, 280), (300, 60)], "plant_doy int, harvest_doy int")).collect()
    assert [(r["plan"], r["harv"]) for r in got] == [(250, 339), (300, 424)]


def test_degree_days_fall_with_the_threshold(spark):
    df = spark.createDataFrame([(1, 8.0, 34.0), (1, 20.0, 20.0), (1, None, 5.0)], "k int, tmin double, tmax double")
    got = {r["tmp"]: r["tempgdds"] for r in SE.degree_days(df, ["k"]).collect()}
    assert list(got.values()) == [got[k] for k in sorted(got)] or all(got[a] >= got[a + 1] for a in range(10, 31))
    assert got[10.0] - got[30.0] >= 0
    assert got[31.0] > 0


def test_slope_bootstrap_and_missing(spark):
    rows = [(1, y, 2.0 * y + (y % 3) * 0.1) for y in range(1990, 2002)] + [(2, y, None if y < 1994 else 1.0) for y in range(1990, 2002)] + [(3, 2000, 1.0)]
    df = spark.createDataFrame(rows, "k int, year int, x double")
    slope = {r["k"]: r["x"] for r in T.trend_slope(df, ["k"], "year", ["x"]).collect()}
    boot = {r["k"]: r for r in T.trend_bootstrap(df, ["k"], "year", "x", nsamp=80).collect()}
    assert abs(boot[1]["x"] - slope[1]) < 4 * math.sqrt(boot[1]["x_var"] / 80) + 4 * math.sqrt(boot[1]["x_var"])
    assert slope[2] is None and slope[3] is None and boot[3]["x"] is None


def test_layers_sum_to_the_column(spark):
    df = spark.createDataFrame([(1, float(p), 98000.0) for p in (5000, 20000, 60000, 95000, 101000)], "k int, p double, ps double")
    out = V.layer_thickness(df, ["k"], "p", "ps", 100.0)
    assert out.agg(F.sum("dp")).first()[0] == pytest.approx(97900.0)
    bad = V.layer_thickness(df.withColumn("ps", F.lit(50.0)), ["k"], "p", "ps", 100.0)
    assert bad.where("dp IS NOT NULL").count() == 0


def test_constant_flux_converges_nowhere_on_the_equator(spark):
    df = spark.createDataFrame([(1, 0.0, float(o), 3.0, 0.0) for o in range(5)], "k int, lat double, lon double, fx double, fy double")
    out = V.convergence(df.union(df.withColumn("lat", F.lit(1.0))), ["k"], "fx", "fy")
    assert all(abs(r["conv"]) < 1e-15 for r in out.collect())


def test_level_between_two(spark):
    df = spark.createDataFrame([(1, 80000.0, 10.0), (1, 90000.0, 20.0)], "k int, p double, t double")
    got = {r["lev"]: r["t"] for r in V.interp_levels(df, ["k"], "p", "t").collect()}
    assert got[85000.0] == 15.0 and got[100000.0] == 30.0 and len(got) == len(V.PRESSURES)
    assert 100000.0 not in {r["lev"] for r in V.interp_levels(df, ["k"], "p", "t", extrapolate=False).collect()}


def test_months_to_days_and_ends(spark):
    df = spark.createDataFrame([(1, dt.date(2000, 1, 16), 0.0), (1, dt.date(2000, 2, 16), 31.0)], "k int, time date, x double")
    out = {r["time"]: r["x"] for r in TG.monthly_to_daily(TG.pad_ends(df, ["k"]), ["k"], ["x"]).collect()}
    assert out[dt.date(2000, 1, 26)] == 10.0 and out[dt.date(2000, 1, 1)] == 0.0 and out[dt.date(2000, 3, 1)] == 31.0


def test_units(spark):
    row = spark.range(1).select(S.precip_mm_day(F.lit(1e-8), F.lit("m/s")).alias("a"), S.convert_flux(F.lit(2.0), F.lit("K")).alias("b"),
                                S.clamp(F.lit(None).cast("double"), 0, 1).alias("c"), S.sine_degree_days(F.lit(30.0), F.lit(30.0), F.lit(10.0)).alias("d")).first()
    assert row["a"] == pytest.approx(0.864) and row["b"] == 2.0 and row["c"] is None and row["d"] == pytest.approx(20.0)
    with pytest.raises(Exception, match="unknown rain unit"):
        spark.range(1).select(S.precip_mm_day(F.lit(1.0), F.lit("furlong"))).collect()


def test_noleap_days_skip_february_29(spark):
    df = spark.createDataFrame([(dt.date(2000, 2, 28),), (dt.date(2000, 2, 29),), (dt.date(2000, 3, 1),), (dt.date(1999, 12, 31),)], "d date")
    got = [r[0] for r in df.select(S.noleap_day(F.col("d"))).collect()]
    assert got[0] == got[1] == got[2] - 1
    assert [r[0] for r in df.select(S.noleap_add_days(F.col("d"), 1)).collect()] == [dt.date(2000, 3, 1), dt.date(2000, 3, 1), dt.date(2000, 3, 2), dt.date(2000, 1, 1)]


def test_names_and_suffixes(spark):
    df = spark.createDataFrame([(1.0, 2.0, float("nan"), 3.0)], "Latitude double, LON double, x double, x_var double")
    c = P.canonical_names(df)
    assert c.columns == ["lat", "lon", "x", "x_var"] and c.first()["x"] is None
    mean, var = P.split_mean_var(c)
    assert mean.columns == ["lat", "lon", "x"] and var.columns == ["lat", "lon", "x"]
    assert P.combine_mean_var(mean, var, ["lat", "lon"]).columns == ["lat", "lon", "x", "x_var"]
    with pytest.raises(ValueError, match="no lat"):
        P.canonical_names(spark.createDataFrame([(1,)], "q int"))
    with pytest.raises(ValueError, match="unknown operation"):
        A.grid_arith(c, c, ["lat", "lon"], "mul")


def test_sinks_and_scans(spark, tmp_path):
    df = spark.createDataFrame([("hist", "01", y, 0.0, 1.0, float(y)) for y in (1, 2)], "scenario string, member string, year int, lat double, lon double, x double")
    io.write_yearly(df, str(tmp_path / "y"))
    io.write_yearly(df.where("year = 2").withColumn("x", F.lit(9.0)), str(tmp_path / "y"))
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "y")).collect()) == [1.0, 9.0]
    for m in ("01", "02"):
        io.write_grid(df.drop("scenario", "member"), str(tmp_path / "runs" / f"rcp_85_{m}"))
    (tmp_path / "runs" / "_SUCCESS").write_text("")
    got = io.scan_runs(spark, str(tmp_path / "runs"))
    assert {(r["scenario"], r["member"]) for r in got.collect()} == {("rcp_85", "01"), ("rcp_85", "02")}
    (tmp_path / "runs" / "rcp_26_01").mkdir()
    (tmp_path / "runs" / "rcp_26_01" / "part.parquet").write_text("not opened unless it is asked for")
    (tmp_path / "runs" / "notes").mkdir()
    some = io.scan_runs(spark, str(tmp_path / "runs"), scenarios=["rcp_85"], members=["02"])
    assert some.count() == 2 and all("rcp_85_02" in f for f in some.inputFiles())
    with pytest.raises(ValueError, match="no such runs"):
        io.scan_runs(spark, str(tmp_path / "runs"), members=["77"])
    assert io.scan_all(spark, str(tmp_path / "runs/rcp_85_01"), str(tmp_path / "runs/rcp_85_02")).count() == 4
    io.write_summary_csv(spark.createDataFrame([(1, "a")], "code int, name string"), str(tmp_path / "c"))
    assert [tuple(r) for r in io.read_codes(spark, str(tmp_path / "c")).collect()] == [(1, "a")]


def test_partitions_do_not_matter(spark):
    from gridstats.plans import QUERIES

    out = []
    for n in ("1", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(tuple, QUERIES["d9_ensemble_stats"](spark, "/root/testdata/sf0.001").collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_divisions_are_guarded():
    """No plain division by a data column in the operators."""
    for f in Path(__file__).parent.parent.joinpath("gridstats/operators").glob("*.py"):
        for line in f.read_text().splitlines():
            assert not re.search(r"/ F\.(sum|avg|count)\(", line), f"{f.name}: {line}"
