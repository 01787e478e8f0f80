"""Projections, selections, renames and reshapes of grid tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Candidate names of the coordinates (fixed values).
LAT_NAMES = ("lat", "latitude", "LAT", "nav_lat", "y")
LON_NAMES = ("lon", "longitude", "LON", "nav_lon", "x")
KEYS = frozenset(("scenario", "member", "ensemble", "year", "month", "time", "lat", "lon", "lev", "statmodel", "tmp", "pft", "cod", "n"))


def value_columns(df: DataFrame, keys: Iterable[str] = KEYS) -> list[str]:
    """Numeric columns that are not coordinates."""
    keys = set(keys)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys]


def select_vars(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Coordinates, the listed variables and their _var twins; names that are absent are passed over."""
    wanted = set(names) | {f"{n}_var" for n in names} | KEYS
    return df.select(*[c for c in df.columns if c in wanted])


def drop_bounds(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith("_bnds")])


def crop_bbox(df: DataFrame, minlat: float, maxlat: float, minlon: float, maxlon: float) -> DataFrame:
    return df.where(F.col("lat").between(minlat, maxlat) & F.col("lon").between(minlon, maxlon))


def slice_time(df: DataFrame, start, end, column: str = "year") -> DataFrame:  # noqa: ANN001
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def select_level(df: DataFrame, lev: float) -> DataFrame:
    """One level; rows without a level get it as a label."""
    return df.where((F.col("lev") == lev) | F.col("lev").isNull()).withColumn("lev", F.lit(float(lev)))


def with_place(df: DataFrame, first: str, *rest: str, place: str = "place") -> DataFrame:
    """Place of each row in the order of first, *rest, from 1: rows before its value of `first` plus its rank within that value.

    Only the counts of the distinct values of `first` are added up in one task.
    """
    before = F.sum("_n").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1))
    counts = df.groupBy(first).agg(F.count("*").alias("_n")).select(F.col(first).alias("_first"), F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(first).orderBy(*rest))
    return df.withColumn("_r", inner).join(counts, F.col(first).eqNullSafe(F.col("_first"))).withColumn(place, F.col("_before") + F.col("_r")).drop("_r", "_first", "_before")


def select_scenarios(df: DataFrame, names: list[str]) -> DataFrame:
    """The listed scenarios with their place in the list as `ord`."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("scenario")).cast("int")
    return df.where(F.col("scenario").isin(names)).withColumn("ord", place)


def rename_vars(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def affine_convert(df: DataFrame, factors: Mapping[str, tuple[float, float]]) -> DataFrame:
    """x * fac + add; a variance x_var only times fac squared."""
    new = {}
    for name, (fac, add) in factors.items():
        new[name] = F.col(name) * fac + add
        if f"{name}_var" in df.columns:
            new[f"{name}_var"] = F.col(f"{name}_var") * fac**2
    return df.withColumns(new)


def add_suffix(df: DataFrame, names: Iterable[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({n: n + suffix for n in names})


def remove_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c.removesuffix(suffix) for c in df.columns if c.endswith(suffix)})


def filter_suffix(df: DataFrame, suffix: str, keep: bool = True, keys: Iterable[str] = KEYS) -> DataFrame:
    """Coordinates and, of the others, those that end in suffix (keep) or do not."""
    keys = set(keys)
    return df.select(*[c for c in df.columns if c in keys or c.endswith(suffix) == keep])


def split_mean_var(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Means, and variances under the names of their means."""
    return filter_suffix(df, "_var", keep=False), remove_suffix(filter_suffix(df, "_var"), "_var")


def combine_mean_var(mean: DataFrame, var: DataFrame, on: list[str]) -> DataFrame:
    return mean.join(add_suffix(var, [c for c in var.columns if c not in on], "_var"), on)


def drop_aux(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(("_pval", "_var"))])


def mask_where(df: DataFrame, names: Iterable[str], condition: Column) -> DataFrame:
    """The columns NULL where the condition does not hold."""
    return df.withColumns({n: F.when(condition, F.col(n)) for n in names})


def mask_by_grid(df: DataFrame, mask: DataFrame, names: Iterable[str]) -> DataFrame:
    """Values only in cells of the mask(lat, lon)."""
    held = mask.select("lat", "lon").distinct().withColumn("_in", F.lit(True))
    return mask_where(df.join(held, ["lat", "lon"], "left"), names, F.col("_in")).drop("_in")


def valid_season(df: DataFrame, names: Iterable[str], length: str = "outslen") -> DataFrame:
    return mask_where(df, names, F.col(length) > 0)


def lon_is_signed(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.max(F.col("lon") < 0), F.lit(False)).alias("signed"))


def canonical_names(df: DataFrame) -> DataFrame:
    """Latitude and longitude under the names lat and lon; NaN values NULL."""
    low = {c.lower(): c for c in df.columns}
    found = {}
    for want, names in (("lat", LAT_NAMES), ("lon", LON_NAMES)):
        have = next((low[n.lower()] for n in names if n.lower() in low), None)
        if have is None:
            raise ValueError(f"no {want} among {df.columns}")
        found[have] = want
    out = df.withColumnsRenamed(found)
    floats = [f.name for f in out.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def recode(df: DataFrame, codes: DataFrame, code: str = "code", names: Iterable[str] | None = None) -> DataFrame:
    """Adds the name of a code; names outside the list are NULL."""
    out = df.join(codes, code, "left")
    return out if names is None else out.withColumn("name", F.when(F.col("name").isin(list(names)), F.col("name")))


def drop_first_if_odd(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return (
        df.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(order)))
        .where((F.col("_n") % 2 == 0) | (F.col("_r") > 1)).drop("_n", "_r")
    )


def drop_first(df: DataFrame, keys: list[str], order: str, n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > n).drop("_r")


def cell_centers(df: DataFrame, north: str, south: str, east: str, west: str, row: str, col: str) -> DataFrame:
    """Adds lat and lon: the mean edge middle of each row and column of a curvilinear grid."""
    lat = df.groupBy(row).agg(F.avg((F.col(north) + F.col(south)) / 2).alias("lat"))
    lon = df.groupBy(col).agg(F.avg((F.col(east) + F.col(west)) / 2).alias("lon"))
    return df.join(lat, row).join(lon, col)


def stack_vars(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.unpivot(keys, names, "variable", "value")


def spread_vars(df: DataFrame, keys: list[str], column: str, values: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).pivot(column, values).agg(F.first(value))


def tag_attrs(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Units and long names from a table keyed by variable."""
    return df.join(meta, "variable", "left")


def to_table(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows with at least one value."""
    return df.dropna(how="all", subset=names)
