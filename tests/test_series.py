"""Series by cell, dense grids and pooled states, against plain loops and in their plans."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridstats.functions import scalar as S
from gridstats.operators import align as A
from gridstats.operators import season as SE
from gridstats.operators import stats as ST
from gridstats.operators import timegrid as TG
from gridstats.operators import trend as T

FIRST = dt.date(1995, 7, 1)


def season_by_hand(rain, base=2.5):
    """Day by day, in hundredths of a mm: extremes that start from day 0, then the last day that equals each."""
    steps = [round(r * 100) - round(base * 100) for r in rain]
    aa, peak, top = [steps[0]], None, None
    for d in range(1, len(steps)):
        aa.append(aa[-1] + steps[d])
        if top is None or steps[d] > top:
            peak, top = d, steps[d]
    low = high = aa[0]
    for d in range(1, len(aa)):
        low = aa[d] if aa[d] < low and d < peak else low
        high = aa[d] if aa[d] > high and d > peak else high
    if sum(steps) >= 0:
        low, high = min(aa), max(aa)
    onset = end = None
    for d in range(1, len(aa)):
        onset = d if aa[d] == low else onset
        end = d if aa[d] == high else end
    return onset, end, None if onset is None or end is None else end - onset


def series(spark, rains):
    rows = [(k, FIRST + dt.timedelta(days=i), r) for k, rain in enumerate(rains) for i, r in enumerate(rain)]
    return SE.complete_ag_years(spark.createDataFrame(rows, "k int, time date, prec double"), ["k"])


def test_rainy_season_is_the_rule_by_hand(spark):
    rng = random.Random(3)
    rains = [[0.0] * 30 + [90.0] + [0.0] * 10 + [1.0] * 20 + [0.0] * 305, [2.5] * 366, [0.0] * 366]
    for _ in range(60):  # dry and wet, with many equal days, so that ties decide
        wet = rng.choice((0.05, 0.2, 0.4))
        rains.append([rng.choice((2.5, 5.0, 12.25, 30.1)) if rng.random() < wet else 0.0 for _ in range(366)])
    got = {r["k"]: (r["outoday"], r["outeday"], r["outslen"]) for r in SE.rainy_season(series(spark, rains), ["k"]).collect()}
    assert got == {k: season_by_hand(rain) for k, rain in enumerate(rains)}
    assert got[0][1] == 31  # the highest accumulation after the steepest day, not on it
    assert {sum(r) >= 2.5 * 366 for r in rains} == {True, False}


def test_season_of_daily_rows_takes_one_exchange_and_one_sort(spark, tmp_path):
    series(spark, [[1.0] * 366] * 3).select("k", "time", "prec").write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    plan = SE.rainy_season(SE.complete_ag_years(days, ["k"]), ["k"])._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange") == 1
    full = SE.rainy_season(SE.ag_year(days), ["k"])._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert full.count("Exchange") == 1 and full.count("Sort [") == 1


def test_fill_days_are_all_days(spark):
    rows = [(1, dt.date(1995, 1, 3), 5.0), (1, dt.date(1995, 1, 6), 7.0), (2, dt.date(1995, 1, 1), 1.0)]
    got = SE.fill_days(spark.createDataFrame(rows, "k int, time date, prec double"), ["k"], {"prec": 0.0}, dt.date(1995, 1, 1))
    assert sorted((r["k"], r["time"].day, r["prec"]) for r in got.collect()) == [
        (1, 1, 0.0), (1, 2, 0.0), (1, 3, 5.0), (1, 4, 0.0), (1, 5, 0.0), (1, 6, 7.0), (2, 1, 1.0)]
    assert SE.fill_days(got.limit(0), ["k"], {"prec": 0.0}, dt.date(1995, 1, 1)).count() == 0


def test_padding_and_days_share_one_exchange(spark, tmp_path):
    rows = [(1, dt.date(2000, m, 16), float(m)) for m in range(1, 6)]
    spark.createDataFrame(rows, "k int, time date, x double").write.parquet(str(tmp_path / "months"))
    out = TG.monthly_to_daily(TG.pad_ends(spark.read.parquet(str(tmp_path / "months")), ["k"]), ["k"], ["x"])
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1
    assert out.count() == (dt.date(2000, 6, 16) - dt.date(1999, 12, 16)).days + 1


def test_sine_forms_are_the_samples(spark):
    rng = random.Random(1)
    days = [(10.0, 30.0, 20.0), (20.0, 20.0, 20.0), (20.0, 20.0, 21.0), (5.0, 15.0, 15.0), (5.0, 15.0, 14.0), (5.0, 15.0, 5.0), (5.0, 15.0, 4.0), (30.0, 10.0, 18.0), (12.5, 17.5, 15.0)]
    days += [(round(rng.uniform(-5, 25), 1), round(rng.uniform(0, 40), 1), float(rng.randint(-5, 35))) for _ in range(400)]
    df = spark.createDataFrame(days, "a double, b double, t double")
    got = df.select("a", "b", "t", S.sine_degree_days(F.col("a"), F.col("b"), F.col("t")).alias("dd"), S.sine_exposure(F.col("a"), F.col("b"), F.col("t")).alias("ex")).collect()
    for r in got:
        temps = [(r["a"] + r["b"]) / 2 + (r["b"] - r["a"]) / 2 * math.sin(2 * math.pi * k / 200) for k in range(200)]
        assert r["dd"] == pytest.approx(sum(max(x - r["t"], 0) for x in temps) / 200, abs=1e-9)
        assert r["ex"] == pytest.approx(sum(r["t"] - 1e-9 <= x <= r["t"] + 1 + 1e-9 for x in temps) / 200, abs=1e-12)
    none = spark.createDataFrame([(None, 3.0)], "a double, b double").select(S.sine_degree_days(F.col("a"), F.col("b"), F.lit(1.0)), S.sine_exposure(F.col("a"), F.col("b"), F.lit(1.0)))
    assert list(none.first()) == [None, None]


def test_degree_days_read_the_table_once(spark, tmp_path):
    spark.range(10).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("tmin"), (F.col("id") + 20).cast("double").alias("tmax")).write.parquet(str(tmp_path / "t"))
    plan = SE.degree_days(spark.read.parquet(str(tmp_path / "t")), ["k"])._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Join" not in plan


def test_first_day_rule_and_one_pass_indices(spark):
    rows = [(1, 0, 10.0), (1, 5, 12.0), (1, 6, 14.0), (2, 5, 20.0), (3, 0, None), (3, 5, 1.0), (4, 0, 9.0)]
    days = spark.createDataFrame(rows, "k int, day_idx int, temp double").withColumns({"tmin": F.col("temp") - 5, "tmax": F.col("temp") + 5, "plan": F.lit(5), "harv": F.lit(7)})
    first = F.when(F.col("day_idx") == 0, F.col("temp"))
    got = {r["k"]: r for r in SE.season_indices(days, ["k"], ["temp"], SE.in_window(), first).collect()}
    assert set(got) == {1, 4}  # series without a value on the first day are skipped
    assert got[1]["tempmean"] == 13.0 and got[1]["ndays"] == 2 and got[4]["tempmean"] is None
    assert got[1]["gdd"] > 0 and got[1]["edd"] == 0


def test_dense_means_and_gaps(spark):
    rows = [("a", 1, 2000, 1.0), ("a", 1, 2001, 3.0), ("a", 2, 2000, None), ("b", 1, 2003, 5.0), (None, 1, 2000, 9.0)]
    df = spark.createDataFrame(rows, "s string, cell int, year int, x double")
    got = {(r["s"], r["cell"]): (r["x"], r["x_var"], r["n"]) for r in ST.mean_var_over(df.where("s IS NOT NULL"), ["s", "cell"], ["x"], dims=["year"]).collect()}
    assert got == {("a", 1): (2.0, 2.0, 3), ("a", 2): (None, None, 3), ("b", 1): (5.0, None, 3), ("b", 2): (None, None, 3)}
    known = df.where("s IS NOT NULL")
    assert {tuple(r) for r in ST.gaps(known, ["s", "cell", "year"]).collect()} == {
        (s, c, y) for s in "ab" for c in (1, 2) for y in (2000, 2001, 2003)} - {(r[0], r[1], r[2]) for r in rows}
    big = spark.range(3000).select((F.col("id") % 50).alias("a"), F.floor(F.col("id") / 50).alias("b"))
    assert ST.gaps(big, ["a", "b"]).count() == 0 and ST.dense_index(big, ["a", "b"]).distinct().count() == 3000
    assert ST.gaps(known.limit(0), ["s", "year"]).count() == 0
    plan = ST.gaps(big, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_pooled_variance_far_from_zero(spark):
    rng = random.Random(5)
    samples = [(m, 1e9 + rng.gauss(0, 1)) for m, size in enumerate((3, 40, 7, 100, 1)) for _ in range(size)]
    groups = ST.mean_var_over(spark.createDataFrame(samples, "m int, x double").withColumn("k", F.lit(1)), ["k", "m"], ["x"])
    got = ST.ensemble_stats(groups, ["k"], ["x"]).first()
    assert got["x_var"] == pytest.approx(statistics.variance(x - 1e9 for _, x in samples), rel=1e-5)
    assert got["n"] == len(samples)
    empty = spark.createDataFrame([(1, None, None, 4)], "k int, x double, x_var double, n int")
    assert ST.ensemble_stats(empty, ["k"], ["x"]).first()["x_var"] is None


def test_bootstrap_draws_are_even_and_independent(spark):
    df = spark.range(300).select(F.explode(T.counter_draws(F.lit(12345).cast("long"), F.col("id"), F.lit(12).cast("long"))).alias("i"))
    counts = [r["count"] for r in df.groupBy("i").count().collect()]
    assert len(counts) == 12 and all(abs(c - 300) < 5 * math.sqrt(300) for c in counts)
    two = spark.range(2).select(T.counter_draws(F.lit(7).cast("long"), F.col("id"), F.lit(50).cast("long")).alias("d")).collect()
    assert two[0]["d"] != two[1]["d"]


def test_bootstrap_of_a_long_series(spark):
    rng = random.Random(2)
    rows = [(1, y, 0.5 * y + rng.gauss(0, 1)) for y in range(3000)]
    got = T.trend_bootstrap(spark.createDataFrame(rows, "k int, year int, x double"), ["k"], "year", "x", nsamp=40).first()
    assert got["x"] == pytest.approx(0.5, abs=1e-3) and 0 < got["x_var"] < 1e-6


def test_axes_are_cut_into_stretches(spark, monkeypatch):
    """Neighbours, nearest values and ranks are those of whole sorted axes, and no task gets a whole one."""
    rng = random.Random(11)
    source = sorted({round(rng.uniform(-90, 90), 2) for _ in range(300)})
    target = sorted({round(rng.uniform(-100, 100), 2) for _ in range(400)} | set(source[:20]))
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "lat double")
    got = {r["lat"]: (r["_lo"], r["_hi"]) for r in A._between(frame(source), frame(target), "lat").collect()}
    assert got == {t: (max((x for x in source if x <= t), default=None), min((x for x in source if x > t), default=None)) for t in target}
    ranks = A._ranked(frame(source), "lat", "v")
    assert {r["v"]: r["_i"] for r in ranks.collect()} == {x: i + 1 for i, x in enumerate(source)}
    g = spark.createDataFrame([(x, 1.0, x) for x in source], "lat double, lon double, x double")
    for out in (A.regrid_nearest(g, g), A.regrid_bilinear(g, g, [], ["x"]), A.snap_join(g, g.drop("x"), []), A.impose_coords(g, g, "lat"), ranks):
        assert "SinglePartition" not in out._jdf.queryExecution().toString()
    assert A._between(frame([]), frame(target), "lat").where("_lo IS NOT NULL OR _hi IS NOT NULL").count() == 0


def inside_by_hand(x, y, rings):
    crossings = 0
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
            crossings += (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0
    return crossings % 2 == 1


RINGS = "shape_no int, rings array<array<struct<x:double,y:double>>>, v double"


def test_shapes_fill_the_cells_that_they_hold(spark):
    """Holes, crossing sides, closed rings, slivers, a large circle of 100 000 corners and one over half the grid."""
    rng = random.Random(13)
    circle = [(3 + 8 * math.cos(2 * math.pi * k / 100_000), -2 + 8 * math.sin(2 * math.pi * k / 100_000)) for k in range(100_000)]
    shapes = {
        1: ([[(-30.0, -20.0), (0.0, -20.0), (0.0, 20.0), (-30.0, 20.0)]], 1.0),
        2: ([circle], 2.0),
        3: ([[(-9.0, -9.0), (9.0, -9.0), (9.0, 9.0), (-9.0, 9.0), (-9.0, -9.0)], [(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)]], -9999.0),
        **{k: ([[(rng.uniform(-25, 25), rng.uniform(-18, 18)) for _ in range(7)]], float(k)) for k in range(4, 9)},
        9: ([[(1.0, 1.0), (2.0, 2.0)], []], 9.0),
    }
    cells = [(a * 0.9 - 18, o * 1.1 - 28) for a in range(41) for o in range(51)]
    frame = spark.createDataFrame(cells, "lat double, lon double")
    poly = spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in ring] for ring in rings], v) for k, (rings, v) in shapes.items()], RINGS)
    raster = A.rasterize(frame, poly, "v", background=-1.0)
    got = {(r["lat"], r["lon"]): r["v"] for r in raster.collect()}
    want = {}
    for lat, lon in cells:
        near = {k: s for k, s in shapes.items() if k != 2 or 7.9 < math.hypot(lon - 3, lat + 2) < 8.1}
        inside = {k for k, (rings, _) in near.items() if inside_by_hand(lon, lat, rings)} | ({2} if math.hypot(lon - 3, lat + 2) <= 7.9 else set())
        v = shapes[max(inside)][1] if inside else -9999.0
        want[lat, lon] = -1.0 if v == -9999.0 else v
    assert got == want
    plan = raster._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_layers_share_the_shapes_cells(spark):
    square = lambda x: [[{"x": x + a, "y": b} for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))]]
    poly = spark.createDataFrame([(1, square(0.0), 0.0), (2, square(1.0), 0.0)], RINGS).drop("v")
    cells = spark.createDataFrame([(0.5, 0.5), (0.5, 1.5), (0.5, 2.5), (0.5, 9.5)], "lat double, lon double")
    facts = spark.createDataFrame([(1, "maize", 1974, 5.0), (2, "maize", 1974, -9999.0), (1, "soy", 1975, 7.0)], "shape_no int, crop string, year int, share double")
    got = {(r["crop"], r["year"], r["lon"]): r["share"] for r in A.rasterize_attributes(cells, poly, facts, ["crop", "year"], ["share"]).collect()}
    assert got == {("maize", 1974, 0.5): 5.0, ("maize", 1974, 1.5): 0.0, ("maize", 1974, 2.5): 0.0, ("maize", 1974, 9.5): 0.0,
                   ("soy", 1975, 0.5): 7.0, ("soy", 1975, 1.5): 7.0, ("soy", 1975, 2.5): 0.0, ("soy", 1975, 9.5): 0.0}
    assert A.rasterize_attributes(cells, poly, facts.limit(0), ["crop", "year"], ["share"]).count() == 0
    assert A.attach_attributes(poly, facts, ["shape_no"], 1974).count() == 2
