"""Months to days."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pad_ends(df: DataFrame, keys: list[str], time: str = "time", days: int = 31) -> DataFrame:
    """The first and last rows of each key again, `days` days outside; one exchange by keys, which monthly_to_daily shares."""
    w = Window.partitionBy(*keys)
    first, last = F.min(time).over(w), F.max(time).over(w)
    at = F.array(F.col(time), F.when(F.col(time) == F.col("_a"), F.date_sub(time, days)), F.when(F.col(time) == F.col("_b"), F.date_add(time, days)))
    rest = [c for c in df.columns if c != time]
    return df.withColumns({"_a": first, "_b": last}).select(*rest, F.explode(F.filter(at, lambda t: t.isNotNull())).alias(time)).select(*df.columns)


def monthly_to_daily(df: DataFrame, keys: list[str], names: Iterable[str], time: str = "time") -> DataFrame:
    """Linear in time between stamped rows: every day from one stamp to the next, per segment, without a search."""
    names = list(names)
    w = Window.partitionBy(*keys).orderBy(time)
    seg = df.select(*keys, F.col(time).alias("_t0"), F.lead(time).over(w).alias("_t1"), *names, *[F.lead(c).over(w).alias(f"_n_{c}") for c in names])
    stop = F.when(F.col("_t1").isNull(), F.col("_t0")).otherwise(F.date_sub("_t1", 1))
    day = seg.select("*", F.explode(F.sequence(F.col("_t0"), stop)).alias(time))
    f = F.coalesce(F.try_divide(F.datediff(time, "_t0"), F.datediff("_t1", "_t0")), F.lit(0.0))
    return day.select(*keys, time, *[(F.when(f == 0, F.col(c)).otherwise(F.col(c) + f * (F.col(f"_n_{c}") - F.col(c)))).alias(c) for c in names])
