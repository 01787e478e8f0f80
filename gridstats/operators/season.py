"""Agricultural years, rainy seasons, crop calendars and degree days."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstats.functions.scalar import sine_degree_days, sine_exposure

#: First month of the agricultural year, rain base in mm a day, degree-day thresholds (fixed values).
START_MONTH = 7
BASE_MM = 2.5
THRESHOLDS = tuple(range(10, 32))


def ag_year(df: DataFrame, time: str = "time", start_month: int = START_MONTH) -> DataFrame:
    """Adds ag_year (the year in which it starts) and ag_day (0 on its first day)."""
    year = F.year(time) - (F.month(time) < start_month).cast("int")
    return df.withColumn("ag_year", year).withColumn("ag_day", F.datediff(F.col(time), F.make_date(year, F.lit(start_month), F.lit(1))))


def complete_ag_years(df: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """Days of agricultural years that hold every day."""
    df = ag_year(df, time)
    w = Window.partitionBy(*keys, "ag_year")
    full = F.datediff(F.make_date(F.col("ag_year") + 1, F.lit(START_MONTH), F.lit(1)), F.make_date(F.col("ag_year"), F.lit(START_MONTH), F.lit(1)))
    return df.withColumn("_n", F.count("*").over(w)).where(F.col("_n") == full).drop("_n")


def fill_days(df: DataFrame, keys: list[str], values: dict[str, object], first: date, time: str = "time") -> DataFrame:
    """Every day of each series from `first` to its last: rows of df, and between them rows with the given values.

    A row stands for the days until the next one, so the gaps need no join: one exchange by keys, which windows over
    keys and year that follow share.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    start = F.when(F.lag(time).over(w).isNull(), F.least(F.lit(first), F.col(time))).otherwise(F.col(time))
    stop = F.coalesce(F.date_sub(F.lead(time).over(w), 1), F.col(time))
    spread = df.withColumns({"_a": start, "_b": stop}).withColumn("_day", F.explode(F.sequence("_a", "_b")))
    return spread.select(*keys, F.col("_day").alias(time), *[
        F.when(F.col("_day") == F.col(time), F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in values.items()
    ])


def accumulation_units(rain: str, base: float) -> Column:
    """Rain less base as a whole number of millionths of a mm, so that sums are the same in any order and ties are exact."""
    return F.round(F.col(rain) * 1_000_000).cast("long") - round(base * 1_000_000)


def anomalous_accumulation(df: DataFrame, keys: list[str], rain: str = "prec", base: float = BASE_MM) -> DataFrame:
    """Adds aa (rain less base, summed from day 0) and daa (its step; NULL on day 0), exact to a millionth of a mm."""
    w = Window.partitionBy(*keys, "ag_year").orderBy("ag_day")
    units = accumulation_units(rain, base)
    aa = F.sum(units).over(w.rowsBetween(Window.unboundedPreceding, 0)) / 1_000_000
    return df.withColumn("aa", aa).withColumn("daa", F.when(F.col("ag_day") > 0, units / 1_000_000))


def steepest_day(df: DataFrame, keys: list[str]) -> DataFrame:
    """First day of the largest step in each agricultural year; equal steps count as equal to a millionth of a mm."""
    steps = df.where(F.col("daa").isNotNull())
    return steps.groupBy(*keys, "ag_year").agg(F.min_by("ag_day", F.struct((-F.col("daa")).alias("d"), F.col("ag_day"))).alias("steepest"))


def rainy_season(df: DataFrame, keys: list[str], rain: str = "prec", base: float = BASE_MM) -> DataFrame:
    """Onset, end and length of the rainy season per agricultural year, as days from its start.

    Where the mean rain reaches base: the days of the lowest and highest accumulation; else the lowest before the steepest
    day and the highest after it, both starting from day 0's value.  The last day of the year (from 1, on either side) on
    which the accumulation equals the extreme counts; none: NULL.
    """
    g = Window.partitionBy(*keys, "ag_year")
    aa, day = F.col("aa"), F.col("ag_day")
    steps = anomalous_accumulation(df, keys, rain, base).withColumns({
        "_wet": F.sum(accumulation_units(rain, base)).over(g) >= 0,
        "_peak": F.min_by("ag_day", F.when(F.col("daa").isNotNull(), F.struct((-F.col("daa")).alias("d"), day))).over(g),
    })
    low = F.min(F.when(F.col("_wet") | (day == 0) | (day < F.col("_peak")), aa)).over(g)
    high = F.max(F.when(F.col("_wet") | (day == 0) | (day > F.col("_peak")), aa)).over(g)
    hit = lambda extreme: F.max(F.when((day >= 1) & (aa == F.col(extreme)), day))
    out = steps.withColumns({"_low": low, "_high": high}).groupBy(*keys, "ag_year").agg(hit("_low").alias("outoday"), hit("_high").alias("outeday"))
    return out.withColumn("outslen", F.col("outeday") - F.col("outoday"))


def calendar_index(calendar: DataFrame, plant: str = "plant_doy", harvest: str = "harvest_doy", shortest: int = 90) -> DataFrame:
    """Adds plan and harv: day indices in a planting year and the next, seasons of at least 90 days."""
    late = lambda c: F.when(F.col(c) < 213, F.col(c) + 365).otherwise(F.col(c))
    plan, harv = late(plant), late(harvest)
    return calendar.withColumn("plan", plan).withColumn("harv", F.when(harv - plan < shortest, plan + shortest).otherwise(harv) - 1)


def fixed_calendar(reference: DataFrame, present: str, plant_doy: int, harvest_doy: int) -> DataFrame:
    """The same dates wherever the reference calendar has any."""
    there = F.col(present).isNotNull()
    return reference.withColumns({"plant_doy": F.when(there, F.lit(plant_doy)), "harvest_doy": F.when(there, F.lit(harvest_doy))})


def two_year_days(df: DataFrame, harvest_year: int, time: str = "time") -> DataFrame:
    """Days of the planting and harvest years with day_idx from 0, without leap days."""
    from gridstats.functions.scalar import noleap_doy

    day = F.to_date(F.col(time))
    span = (F.col(time) >= F.lit(date(harvest_year - 1, 1, 1))) & (F.col(time) < F.lit(date(harvest_year + 1, 1, 1)))
    leap = (F.month(day) == 2) & (F.dayofmonth(day) == 29)
    return df.where(span & ~leap).withColumn(
        "day_idx", ((F.year(day) - (harvest_year - 1)) * 365 + noleap_doy(day) - 1).cast("int")
    )


def in_window() -> Column:
    """Whether a day lies in its series' calendar window."""
    return (F.col("day_idx") >= F.col("plan")) & (F.col("day_idx") < F.col("harv"))


def season_means(days: DataFrame, keys: list[str], names: Iterable[str], inside: Column | None = None, first: Column | None = None, more: Iterable[Column] = ()) -> DataFrame:
    """Means over the days of the calendar window and its length; days(keys, plan, harv, names), in one pass.

    inside: which days are in the window, if there are others.  first: a value that only the series' first day has;
    series without it give no row.  more: further aggregates of the same pass.
    """
    within = lambda c: F.col(c) if inside is None else F.when(inside, F.col(c))
    out = days.groupBy(*keys).agg(
        *[F.avg(within(c)).alias(f"{c}mean") for c in names], F.max(F.col("harv") - F.col("plan")).alias("ndays"), *more,
        *([F.count(first).alias("_first")] if first is not None else []))
    return out if first is None else out.where("_first > 0").drop("_first")


def season_indices(days: DataFrame, keys: list[str], names: Iterable[str], inside: Column, first: Column, low: float = 10.0, high: float = 30.0) -> DataFrame:
    """season_means with edd (degree days above high) and gdd (those between low and high) of the window, in the same pass."""
    above = lambda t: F.sum(F.when(inside, sine_degree_days(F.col("tmin"), F.col("tmax"), F.lit(t))))
    return season_means(days, keys, names, inside, first, [above(high).alias("edd"), (above(low) - above(high)).alias("gdd")])


def degree_days(days: DataFrame, keys: list[str], tmin: str = "tmin", tmax: str = "tmax", thresholds: Iterable[int] = THRESHOLDS, exposure: bool = False) -> DataFrame:
    """Sum over days for each threshold tmp: degree days, or the share of days within [tmp, tmp + 1].

    One pass: a day's value at a threshold is a closed form of its two temperatures.  Days meet the thresholds within their task and are summed
    there before anything is exchanged.
    """
    f = sine_exposure if exposure else sine_degree_days
    name = "exposure" if exposure else "tempgdds"
    at = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("tmp")
    each = days.select(*keys, F.col(tmin).alias("_lo"), F.col(tmax).alias("_hi"), at)
    return each.groupBy(*keys, "tmp").agg(F.sum(f(F.col("_lo"), F.col("_hi"), F.col("tmp"))).alias(name))


def gdd_edd(gdds: DataFrame, keys: list[str], low: float = 10.0, high: float = 30.0) -> DataFrame:
    """edd above high, gdd between low and high."""
    at = lambda x: F.max(F.when(F.col("tmp") == x, F.col("tempgdds")))
    return gdds.groupBy(*keys).agg(at(high).alias("edd"), (at(low) - at(high)).alias("gdd"))


def in_season(length: Column, x: Column) -> Column:
    return F.when(length > 0, x)
