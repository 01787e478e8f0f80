"""Trends: slopes, bootstrap and regression summaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstats.functions.scalar import student_t_pvalue

#: Odd multipliers and steps of the counter-based generator (fixed values, shared with the oracle).
MODULUS = 2147483648
BY_SEED, BY_REPLICATE, BY_DRAW = 1640531527, 1013904223, 1664525
MIX_1, MIX_2 = 1812433253, 1566083941


def trend_slope(df: DataFrame, keys: list[str], x: str, names: Iterable[str], most_missing: int = 3) -> DataFrame:
    """Least-squares slope on x; NULL with more than most_missing missing values."""
    return df.groupBy(*keys).agg(*[
        F.when(F.count("*") - F.count(y) <= most_missing, F.regr_slope(F.col(y), F.col(x))).alias(y) for y in names
    ])


def counter_draws(seed: Column, replicate: Column, n: Column) -> Column:
    """n numbers from 0 to n - 1, each of its own seed, replicate and place: draws have no order and carry no state.

    A step a transform, as a lambda works an argument out anew wherever it stands.
    """
    step = lambda shift, by: lambda x: F.pmod(x.bitwiseXOR(F.shiftright(x, shift)) * by, F.lit(MODULUS))
    start = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.pmod(seed * BY_SEED + replicate * BY_REPLICATE + i * BY_DRAW, F.lit(MODULUS)))
    mixed = F.transform(F.transform(start, step(15, MIX_1)), step(13, MIX_2))
    return F.transform(mixed, lambda x: F.shiftright(x.bitwiseXOR(F.shiftright(x, 16)) * n, 31).cast("int"))


def trend_bootstrap(df: DataFrame, keys: list[str], x: str, y: str, nsamp: int = 30, seed: int = 1) -> DataFrame:
    """Mean and variance (ddof 0) of the slopes of nsamp resamples with replacement per group.

    A group's series is one array; replicates are rows, so the work spreads over groups times replicates.  A replicate is
    five sums over as many draws as the series is long; each draw is a number of its own, by seed, group, replicate and place, so groups are
    resampled independently and nothing is copied or carried on.
    """
    one = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    series = one.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"), F.avg(x).alias("_mid")
    ).withColumn("p", F.transform("p", lambda v: F.struct((v["x"] - F.col("_mid")).alias("x"), v["y"].alias("y"))))
    group = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 7), 16, 10).cast("long")
    reps = series.select(*keys, "p", (group + seed).alias("_g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nsamp - 1).cast("long"))).alias("r"))
    n = F.size("p")
    drawn = F.transform(counter_draws(F.col("_g"), F.col("r"), n.cast("long")), lambda i: F.col("p")[i])
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("sx", "sy", "sxx", "sxy")])

    def add(s: Column, v: Column) -> Column:
        return F.struct((s["sx"] + v["x"]).alias("sx"), (s["sy"] + v["y"]).alias("sy"), (s["sxx"] + v["x"] * v["x"]).alias("sxx"), (s["sxy"] + v["x"] * v["y"]).alias("sxy"))

    s = F.col("_s")
    down = n * s["sxx"] - s["sx"] * s["sx"]
    sums = reps.select(*keys, "p", F.aggregate(drawn, zero, add).alias("_s"))
    slopes = sums.select(*keys, F.when(F.abs(down) > 1e-9, F.try_divide(n * s["sxy"] - s["sx"] * s["sy"], down)).alias("b"))
    ok = F.count("b") == F.count("*")  # a singular resample leaves no estimate
    return slopes.groupBy(*keys).agg(F.when(ok, F.avg("b")).alias(y), F.when(ok, F.var_pop("b")).alias(f"{y}_var"))


def regression_summary(df: DataFrame, keys: list[str], x: str, y: str, level: float = 0.05) -> DataFrame:
    """n, slope, intercept, r2, p of the slope and the equation as text."""
    a, b = F.col(y), F.col(x)
    g = df.groupBy(*keys).agg(
        F.regr_count(a, b).alias("n"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2")
    )
    d = F.col("n") - 2
    t = F.sqrt(F.try_divide(F.col("r2") * d, F.greatest(1 - F.col("r2"), F.lit(1e-15))))
    p = F.when(d > 0, student_t_pvalue(t, F.greatest(d, F.lit(1)).cast("int")))
    text = F.format_string("y = %.3f x + %.3f; R2 = %.2f; p %s", F.col("slope"), F.col("intercept"), F.col("r2"),
                           F.when(F.col("pvalue") <= level, f"<{level}").otherwise(F.format_string("= %.2f", F.col("pvalue"))))
    return g.withColumn("pvalue", p).withColumn("equation", F.when(F.col("slope").isNotNull() & F.col("pvalue").isNotNull(), text))
