"""Tests of differences and masks by significance."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstats.functions.scalar import normal_quantile, percent_diff, student_t_pvalue


def pooled_t(m1: Column, v1: Column, n1: Column | int, m2: Column, v2: Column, n2: Column | int) -> Column:
    """Two-sample t from summaries, common variance."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (n1, n2))
    common = F.try_divide((a - 1) * v1 + (b - 1) * v2, a + b - 2)
    return F.try_divide(m1 - m2, F.sqrt(common * (F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b))))


def diff_ttest(a: DataFrame, b: DataFrame, on: list[str], names: Iterable[str], n1: Column | int, n2: Column | int | None = None, percent: bool = False) -> DataFrame:
    """a - b with p (_pval), summed variance (_var) and, if asked, percent of b (_perc, _perc_pval)."""
    names = list(names)
    side = lambda d, p: d.select(*on, *[F.col(c).alias(p + c) for c in [*names, *[f"{v}_var" for v in names]]])
    return _differences(side(a, "_a_").join(side(b, "_b_"), on), on, names, n1, n2, percent)


def diff_ttest_within(df: DataFrame, column: str, left: str, right: str, on: list[str], names: Iterable[str], n1: Column | int, n2: Column | int | None = None, percent: bool = False) -> DataFrame:
    """diff_ttest of the rows left and right of `column`, one each per key, from one pass over df."""
    names = list(names)
    value = lambda c, v: F.max(F.when(F.col(column) == v, F.col(c)))
    both = df.where(F.col(column).isin(left, right)).groupBy(*on).agg(
        (F.max(F.col(column) == left) & F.max(F.col(column) == right)).alias("_both"),
        *[value(c, v).alias(p + c) for p, v in (("_a_", left), ("_b_", right)) for c in [*names, *[f"{x}_var" for x in names]]],
    ).where("_both")
    return _differences(both, on, names, n1, n2, percent)


def diff_ttest_pairs(df: DataFrame, column: str, pairs: Iterable[tuple[str, str, str]], on: list[str], names: Iterable[str], n1: Column | int, n2: Column | int | None = None, percent: bool = False) -> DataFrame:
    """diff_ttest of several pairs(effect, left, right) of `column`'s values, one row each per key, from one pass over df; keys without both sides have no row."""
    names, pairs = list(names), list(pairs)
    every = [*names, *[f"{x}_var" for x in names]]
    sides = sorted({v for _, a, b in pairs for v in (a, b)})
    wide = df.where(F.col(column).isin(sides)).groupBy(*on).agg(*[
        F.max(F.when(F.col(column) == v, F.struct(*every))).alias(f"_s{i}") for i, v in enumerate(sides)
    ])
    side = lambda v: F.col(f"_s{sides.index(v)}")
    each = wide.select(*on, F.explode(F.array(*[F.struct(F.lit(e).alias("effect"), side(a).alias("a"), side(b).alias("b")) for e, a, b in pairs])).alias("_p"))
    both = each.where("_p.a IS NOT NULL AND _p.b IS NOT NULL").select(
        "_p.effect", *on, *[F.col(f"_p.{k}.{c}").alias(f"_{k}_{c}") for k in ("a", "b") for c in every])
    return _differences(both, ["effect", *on], names, n1, n2, percent)


def _differences(both: DataFrame, on: list[str], names: list[str], n1: Column | int, n2: Column | int | None, percent: bool) -> DataFrame:
    n2 = n1 if n2 is None else n2
    x, y = (v if isinstance(v, Column) else F.lit(v) for v in (n1, n2))
    out = []
    for c in names:
        m1, v1, m2, v2 = (F.col(k) for k in (f"_a_{c}", f"_a_{c}_var", f"_b_{c}", f"_b_{c}_var"))
        p = student_t_pvalue(pooled_t(m1, v1, x, m2, v2, y), (x + y - 2).cast("int"))
        out += [(m1 - m2).alias(c), p.alias(f"{c}_pval"), (v1 + v2).alias(f"{c}_var")]
        if percent:
            out += [percent_diff(m1, m2).alias(f"{c}_perc"), p.alias(f"{c}_perc_pval")]
    return both.select(*on, *out)


def ttest_vs_constant(mean: Column, var: Column, n: Column | int, constant: float = 0.0, df: Column | int | None = None) -> Column:
    """p of a mean against a constant; by default 2n - 2 degrees, as of two samples of which one has no spread."""
    k = n if isinstance(n, Column) else F.lit(n)
    t = F.try_divide(mean - constant, F.sqrt(F.try_divide(var, k)))
    d = (2 * k - 2) if df is None else df if isinstance(df, Column) else F.lit(df)
    return student_t_pvalue(t, d.cast("int"))


def ttest_samples(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """diff, statistic and p of two raw samples per key."""
    side = lambda d, p: d.groupBy(*keys).agg(F.avg(value).alias(f"{p}m"), F.var_samp(value).alias(f"{p}v"), F.count(value).alias(f"{p}n"))
    both = side(a, "a").join(side(b, "b"), keys)
    t = pooled_t(F.col("am"), F.col("av"), F.col("an"), F.col("bm"), F.col("bv"), F.col("bn"))
    return both.select(*keys, (F.col("am") - F.col("bm")).alias("diff"), t.alias("statistic"), student_t_pvalue(t, (F.col("an") + F.col("bn") - 2).cast("int")).alias("pvalue"))


def significance_mask(x: Column, p: Column, level: float = 0.05) -> Column:
    return F.when(p <= level, x)


def vector_mask(x: Column, pu: Column, pv: Column, level: float = 0.05) -> Column:
    """Kept if either component is significant."""
    return F.when((pu <= level) | (pv <= level), x)


def confidence_interval(mean: Column, var: Column, level: float = 0.95) -> tuple[Column, Column]:
    half = normal_quantile((1 + level) / 2) * F.sqrt(var)
    return mean - half, mean + half


def significance_class(p: Column, breaks: tuple[float, ...] = (0.01, 0.05)) -> Column:
    """0 for p up to the first break, 1 up to the second, and so on."""
    out = F.when(p.isNull(), F.lit(None).cast("int"))
    for i, b in enumerate(breaks):
        out = out.when(p <= b, i)
    return out.otherwise(len(breaks))
