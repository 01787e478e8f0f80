"""Climatologies, pooled ensemble statistics and weighted means."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets into which an axis is dealt to be numbered.
BUCKETS = 64


def _bucket(axis: str) -> Column:
    return F.pmod(F.xxhash64(axis), F.lit(BUCKETS)).cast("int")


def axis_buckets(df: DataFrame, axes: Iterable[str]) -> dict[str, dict[int, int]]:
    """Distinct values of each axis by bucket, all axes in one pass; what reaches the driver is BUCKETS numbers an axis."""
    axes = list(axes)
    each = df.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("axis"), _bucket(a).alias("bucket"), F.col(a).cast("string").alias("v")) for a in axes
    ])).alias("e")).select("e.*")
    found = each.where("v IS NOT NULL").distinct().groupBy("axis", "bucket").agg(F.count("*").alias("n"))
    out: dict[str, dict[int, int]] = {a: {} for a in axes}
    for r in found.collect():
        out[r["axis"]][r["bucket"]] = r["n"]
    return out


def axis_lengths(df: DataFrame, axes: Iterable[str]) -> dict[str, int]:
    """Number of distinct values of each axis, in one pass."""
    return {a: sum(b.values()) for a, b in axis_buckets(df, axes).items()}


def numbered(df: DataFrame, axis: str, sizes: dict[int, int]) -> DataFrame:
    """(axis, _no): the distinct values of an axis numbered from 0, in buckets by hash (of these sizes), so no task holds a whole axis."""
    values = df.select(axis).where(F.col(axis).isNotNull()).distinct().withColumn("_b", _bucket(axis))
    before = [sum(sizes.get(k, 0) for k in range(b)) for b in range(BUCKETS)]
    place = F.row_number().over(Window.partitionBy("_b").orderBy(axis)) - 1 + F.element_at(F.array(*[F.lit(n) for n in before]), F.col("_b") + 1)
    return values.select(axis, place.cast("long").alias("_no"))


def dense_index(df: DataFrame, axes: Iterable[str], sizes: dict[str, dict[int, int]] | None = None) -> DataFrame:
    """Every combination of the values that the axes have in df: a range of numbers, each taken apart into places on the axes.

    The range is spread over tasks and meets each numbered axis by an equi-join on the place; nothing is joined crosswise.
    """
    axes = list(axes)
    sizes = axis_buckets(df, axes) if sizes is None else sizes
    length = {a: sum(sizes[a].values()) for a in axes}
    out, stride = df.sparkSession.range(math.prod(length.values())), 1
    for a in axes:
        out = out.withColumn(f"_at_{a}", (F.floor(F.col("id") / F.lit(stride)) % max(length[a], 1)).cast("long"))
        stride *= max(length[a], 1)
    for a in axes:
        out = out.join(numbered(df, a, sizes[a]).withColumnRenamed("_no", f"_at_{a}"), f"_at_{a}")
    return out.select(*axes)


def gaps(df: DataFrame, axes: Iterable[str], sizes: dict[str, dict[int, int]] | None = None) -> DataFrame:
    """Combinations of the axes' values that df has no row for."""
    axes = list(axes)
    return dense_index(df, axes, sizes).join(df.select(*axes), axes, "left_anti")


def mean_var_over(df: DataFrame, keys: list[str], names: Iterable[str], n: Column | None = None, dims: Iterable[str] | None = None) -> DataFrame:
    """Mean, sample variance (_var) and number of rows over everything but keys, in one pass.

    dims: the table stands for a dense grid over keys and dims.  n is then the product of the dims' lengths, whether or not
    values are present, and every combination of the keys' values has a row; those without values have NULL.
    """
    names = list(names)
    aggs = [F.avg(c).alias(c) for c in names] + [F.var_samp(c).alias(f"{c}_var") for c in names]
    if dims is None:
        return df.groupBy(*keys).agg(*aggs, (F.count("*") if n is None else n).alias("n"))
    dims = list(dims)
    sizes = axis_buckets(df, [*keys, *dims])
    product = math.prod(sum(sizes[d].values()) for d in dims)
    have = df.groupBy(*keys).agg(*aggs)
    return have.unionByName(gaps(df, keys, sizes), allowMissingColumns=True).withColumn("n", F.lit(product).cast("long"))


def monthly_climatology(df: DataFrame, names: Iterable[str], keys: list[str] | None = None) -> DataFrame:
    return mean_var_over(df, keys or ["scenario", "member", "month", "lat", "lon"], names)


def pooled_mean(mean: str, n: str = "n") -> Column:
    """Mean of all samples from the means of groups of n."""
    seen = F.when(F.col(mean).isNotNull(), F.col(n))
    return F.try_divide(F.sum(F.col(mean) * seen), F.sum(seen))


def pooled_variance(mean: str, var: str, n: str = "n") -> Column:
    """Variance (n - 1) of all samples together from groups' means, variances and sizes.

    The spread of the means comes from covariances, which Spark holds as counts, means and sums of centred products and merges pair
    by pair.  So it aggregates partially, in any order, and means far from 0 cost no digits: with a the plain mean of means,
    sum n (m - a)^2 = C(n m, m) - a C(n, m), less what moves a to the pooled mean.
    """
    m = F.col(mean)
    w = F.when(m.isNotNull(), F.col(n)).cast("double")
    within = F.coalesce((w - 1) * F.col(var), F.when(w == 1, F.lit(0.0)))
    k, total, moved = F.count(m), F.sum(w), F.covar_pop(w, m)
    about = F.covar_pop(w * m, m) - F.avg(m) * moved
    between = k * about - F.try_divide(F.pow(k * moved, F.lit(2)), total)
    return F.try_divide(F.sum(within) + F.greatest(between, F.lit(0.0)), total - 1)


def ensemble_stats(df: DataFrame, keys: list[str], names: Iterable[str], n: str | Column = "n") -> DataFrame:
    """Mean over members and pooled variance of columns with a _var twin."""
    if isinstance(n, Column):
        df, n = df.withColumn("_n", n), "_n"
    aggs = []
    for c in names:
        aggs += [F.avg(c).alias(c), pooled_variance(c, f"{c}_var", n).alias(f"{c}_var")]
    return df.groupBy(*keys).agg(*aggs, F.sum(n).alias("n"))


def pool_pair_mean(m1: Column, n1: Column, m2: Column, n2: Column) -> Column:
    return F.try_divide(n1 * m1 + n2 * m2, n1 + n2)


def pool_pair_variance(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    """Variance of two samples together."""
    d = m1 - m2
    return F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2 + F.try_divide(n1 * n2, n1 + n2) * d * d, n1 + n2 - 1)


def weighted_mean(df: DataFrame, keys: list[str], names: Iterable[str], weight: str, masked: bool = False) -> DataFrame:
    """Weighted means of all columns in one pass; masked: only weights of rows with a value count."""
    w = F.col(weight)
    return df.groupBy(*keys).agg(*[
        F.try_divide(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w) if masked else w)).alias(c) for c in names
    ])


def means_by_weights(df: DataFrame, keys: list[str], value: str, weights: dict[str, Column | None]) -> DataFrame:
    """One mean of a column for each named weight (None: unweighted), in one pass."""
    x = F.col(value)
    return df.groupBy(*keys).agg(*[
        (F.avg(x) if w is None else F.try_divide(F.sum(x * w), F.sum(w))).alias(name) for name, w in weights.items()
    ])


def class_sum(df: DataFrame, keys: list[str], column: str, codes: Iterable[int], value: str) -> DataFrame:
    """Sum over listed classes, 0 where there is none."""
    inside = F.when(F.col(column).isin(list(codes)), F.col(value))
    return df.groupBy(*keys).agg(F.coalesce(F.sum(inside), F.lit(0.0)).alias(value))


def envelope(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def with_multi_model_mean(df: DataFrame, keys: list[str], names: Iterable[str], model: str = "statmodel", label: str = "Ensemble") -> DataFrame:
    names = list(names)
    mean = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names]).withColumn(model, F.lit(label))
    return df.select(*keys, model, *names).unionByName(mean)


def symmetric_limit(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Largest absolute value of any of the columns."""
    return df.agg(F.greatest(*[F.greatest(F.abs(F.max(c)), F.abs(F.min(c))) for c in names], F.lit(0.0)).alias("limit"))


def sum_variables(names: Iterable[str]) -> Column:
    """Row sum; missing propagates."""
    return reduce(lambda a, b: a + b, (F.col(c) for c in names))


def short_years(df: DataFrame, keys: list[str], days: int = 365) -> DataFrame:
    """Years with some days but not all."""
    return df.groupBy(*keys, "year").agg(F.countDistinct("time").alias("days")).where(F.col("days") != days)
