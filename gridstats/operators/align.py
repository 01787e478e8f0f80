"""Joins on coordinates: arithmetic, merges, regridding, zones and polygons."""

from __future__ import annotations

import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OPS = {"add": operator.add, "sub": operator.sub}


def grid_arith(a: DataFrame, b: DataFrame, on: list[str], op: str = "sub") -> DataFrame:
    """a op b for the variables of both; variances (_var) add in either case."""
    if op not in _OPS:
        raise ValueError(f"unknown operation: {op}")
    common = [c for c in a.columns if c in b.columns and c not in on]
    right = b.select(*on, *[F.col(c).alias(f"_r_{c}") for c in common])
    both = a.select(*on, *common).join(right, on)
    f = _OPS[op]
    return both.select(*on, *[
        (F.col(c) + F.col(f"_r_{c}") if c.endswith("_var") else f(F.col(c), F.col(f"_r_{c}"))).alias(c) for c in common
    ])


def merge_grids(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Outer merge of different variables."""
    return a.join(b, on, "full_outer")


def axis_of(df: DataFrame, axis: str) -> DataFrame:
    """The distinct values of a coordinate: as long as the grid is wide, whatever the table's length."""
    return df.select(axis).where(F.col(axis).isNotNull()).distinct()


#: Stretches into which an axis is cut.
STRETCHES = 32


def _bounds(df: DataFrame, axis: str) -> list[float]:
    """Values of an axis that cut it into stretches of like length; what reaches the driver is STRETCHES numbers at most."""
    shares = [k / STRETCHES for k in range(1, STRETCHES)]
    found = axis_of(df, axis).agg(F.percentile_approx(F.col(axis), shares).alias("b")).first()["b"]
    return sorted(set(found or []))


def _stretch(axis: str, bounds: list[float]) -> Column:
    """How many of the bounds are at or below a value."""
    values = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    return F.size(F.filter(values, lambda b: b <= F.col(axis)))


def _between(source: DataFrame, target: DataFrame, axis: str) -> DataFrame:
    """(axis of target, _lo, _hi): the source values at or below it and above it, NULL where there is none.

    Both axes are cut into the same stretches and sorted there, so no task holds a whole axis.  Every stretch but the first begins with a
    source value, its bound: what lies below a value is in its stretch, and what lies above is there too or is the next bound.
    """
    bounds = _bounds(source, axis)
    both = axis_of(source, axis).select(axis, F.col(axis).alias("_s"), F.lit(False).alias("_t")).unionByName(
        axis_of(target, axis).select(axis, F.lit(None).cast("double").alias("_s"), F.lit(True).alias("_t"))
    ).groupBy(axis).agg(F.max("_s").alias("_s"), F.max("_t").alias("_t")).withColumn("_part", _stretch(axis, bounds))
    up = Window.partitionBy("_part").orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_part").orderBy(F.desc(axis)).rowsBetween(Window.unboundedPreceding, -1)
    following = F.get(F.array(*[F.lit(b) for b in bounds]), F.col("_part")) if bounds else F.lit(None).cast("double")
    return both.select(
        axis, "_t", F.last("_s", True).over(up).alias("_lo"), F.coalesce(F.last("_s", True).over(down), following).alias("_hi")
    ).where("_t").drop("_t")


def _ranked(df: DataFrame, axis: str, name: str) -> DataFrame:
    """(name, _i): the values of an axis in order, numbered from 1; the stretches' sizes go over the driver."""
    values = axis_of(df, axis).withColumn("_part", _stretch(axis, _bounds(df, axis)))
    sizes = {r["_part"]: r["n"] for r in values.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before = [sum(sizes.get(k, 0) for k in range(p)) for p in range(max(sizes, default=0) + 1)]
    place = F.row_number().over(Window.partitionBy("_part").orderBy(axis)) + F.get(F.array(*[F.lit(n) for n in before]), F.col("_part"))
    return values.select(F.col(axis).alias(name), place.alias("_i"))


def _near_axis(source: DataFrame, target: DataFrame, axis: str) -> DataFrame:
    """(axis of target, `_axis` of source, _in): the nearest source value, ties take the smaller; _in: within the source's range."""
    x, lo, hi = F.col(axis), F.col("_lo"), F.col("_hi")
    return _between(source, target, axis).select(
        axis, F.when(hi.isNull() | (x - lo <= hi - x), lo).otherwise(hi).alias(f"_{axis}"),
        (lo.isNotNull() & (hi.isNotNull() | (lo == x))).alias("_in"),
    ).where(F.col(f"_{axis}").isNotNull())


def snap_join(a: DataFrame, b: DataFrame, on: list[str], tol: float = 0.001) -> DataFrame:
    """a joined with b on `on`, latitudes and longitudes of b matched to a's within tol."""
    for axis in ("lat", "lon"):
        near = _near_axis(b, a, axis).where(F.abs(F.col(axis) - F.col(f"_{axis}")) <= tol).drop("_in")
        b = b.withColumnRenamed(axis, f"_{axis}").join(near, f"_{axis}").drop(f"_{axis}")
    return a.join(b, [*on, "lat", "lon"])


def regrid_nearest(df: DataFrame, target: DataFrame) -> DataFrame:
    """df on the axes of target(lat, lon): the nearest cell, nothing outside the source's range."""
    for axis in ("lat", "lon"):
        near = _near_axis(df, target, axis).where("_in").drop("_in")
        df = df.withColumnRenamed(axis, f"_{axis}").join(near, f"_{axis}").drop(f"_{axis}")
    return df


def _brackets(source: DataFrame, target: DataFrame, axis: str) -> DataFrame:
    """(axis, _axis, _w): the source values on either side with linear weights; a hit has one side."""
    inside = _between(source, target, axis).where(F.col("_lo").isNotNull() & (F.col("_hi").isNotNull() | (F.col("_lo") == F.col(axis))))
    w = F.coalesce(F.try_divide(F.col(axis) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    ends = F.array(F.struct(F.col("_lo").alias("at"), (1 - w).alias("w")), F.struct(F.col("_hi").alias("at"), w.alias("w")))
    return inside.select(axis, F.explode(F.filter(ends, lambda e: e["w"] > 0)).alias("_e")).select(
        axis, F.col("_e.at").alias(f"_{axis}"), F.col("_e.w").alias(f"_w{axis}")
    )


def regrid_bilinear(df: DataFrame, target: DataFrame, keys: list[str], names: Iterable[str]) -> DataFrame:
    """Linear in both axes; NULL where a corner with weight is missing, nothing outside the source."""
    lat, lon = _brackets(df, target, "lat"), _brackets(df, target, "lon")
    need = lat.groupBy("lat").agg(F.count("*").alias("_nlat")), lon.groupBy("lon").agg(F.count("*").alias("_nlon"))
    src = df.withColumnsRenamed({"lat": "_lat", "lon": "_lon"})
    corners = src.join(lat.join(need[0], "lat"), "_lat").join(lon.join(need[1], "lon"), "_lon")
    w = F.col("_wlat") * F.col("_wlon")
    n = F.max(F.col("_nlat") * F.col("_nlon"))
    return corners.groupBy(*keys, "lat", "lon").agg(*[F.when(F.count(v) == n, F.sum(F.col(v) * w)).alias(v) for v in names])


def impose_coords(df: DataFrame, target: DataFrame, axis: str) -> DataFrame:
    """The i-th value of an axis becomes the target's i-th value."""
    pairs = _ranked(df, axis, "_old").join(_ranked(target, axis, "_new"), "_i").drop("_i")
    return df.join(pairs, F.col(axis) == F.col("_old")).withColumn(axis, F.col("_new")).drop("_old", "_new")


def attach_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins a table keyed by grid cell, latitude or code; Spark broadcasts it if it is small."""
    return df.join(small, on, how)


def attach_attributes(shapes: DataFrame, attributes: DataFrame, on: list[str], *years: int, year: str = "year") -> DataFrame:
    """Shapes with their attributes in the given years (all, if none is named): one row a shape and year, shapes without are left out.

    The years' filter stands below the join and reaches the attributes' scan.
    """
    some = attributes.where(F.col(year).isin(list(years))) if years else attributes
    return shapes.join(some, on)


def control_diff(df: DataFrame, pairs: DataFrame, on: list[str], names: Iterable[str], label: str = "scenario") -> DataFrame:
    """Differences of named pairs(effect, left, right) of scenarios in one plan; variances add."""
    names = list(names)
    side = lambda p, to: df.select(F.col(label).alias(to), *on, *[F.col(c).alias(f"{p}{c}") for c in names])
    both = side("_a_", "left").join(pairs, "left").join(side("_b_", "right"), ["right", *on])
    return both.select("effect", *on, *[
        (F.col(f"_a_{c}") + F.col(f"_b_{c}") if c.endswith("_var") else F.col(f"_a_{c}") - F.col(f"_b_{c}")).alias(c) for c in names
    ])


def reference_period_join(df: DataFrame, keys: list[str], base_year: int, names: Iterable[str], year: str = "year") -> DataFrame:
    """Adds the base year's values as *_base."""
    base = df.where(F.col(year) == base_year).select(*keys, *[F.col(c).alias(f"{c}_base") for c in names])
    return df.join(base, keys)


def calendar_join(days: DataFrame, calendar: DataFrame, on: list[str]) -> DataFrame:
    """Days with plant <= day_idx < harv of their cell's calendar."""
    return days.join(calendar, on).where((F.col("day_idx") >= F.col("plan")) & (F.col("day_idx") < F.col("harv")))


def edges_of(polygons: DataFrame, *keep: str) -> DataFrame:
    """(shape_no, keep, x0, y0, x1, y1): the sides of all rings, closed or not, each side once."""
    ring = polygons.select("shape_no", *keep, F.explode("rings").alias("_r")).where(F.size("_r") > 2)
    n = F.size("_r")
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.col("_r")[i].alias("a"), F.col("_r")[(i + 1) % n].alias("b")))
    return ring.select("shape_no", *keep, F.explode(sides).alias("_e")).select(
        "shape_no", *keep, F.col("_e.a.x").alias("x0"), F.col("_e.a.y").alias("y0"), F.col("_e.b.x").alias("x1"), F.col("_e.b.y").alias("y1"))


def spans_of(edges: DataFrame, rows: DataFrame, *keep: str, tile: float = 5.0) -> DataFrame:
    """(shape_no, keep, lat, _lo, _hi): the stretches lo <= lon < hi of each row(lat) inside each shape, by the even-odd rule.

    A side meets the rows of the bands that it crosses, by an equi-join; a row's crossings in order are the ends of its stretches, so the
    work follows sides times rows crossed, however many corners a shape has.
    """
    band = lambda c: F.floor(c / tile)
    bands = F.sequence(band(F.least("y0", "y1")), band(F.greatest("y0", "y1")))
    tall = edges.where(F.col("y0") != F.col("y1")).withColumn("_band", F.explode(bands))
    met = tall.join(rows.select("lat", band(F.col("lat")).alias("_band")), "_band").where((F.col("y0") > F.col("lat")) != (F.col("y1") > F.col("lat")))
    at = (F.col("x1") - F.col("x0")) * F.try_divide(F.col("lat") - F.col("y0"), F.col("y1") - F.col("y0")) + F.col("x0")
    order = Window.partitionBy("shape_no", "lat").orderBy("_lo")
    ends = met.select("shape_no", *keep, "lat", at.alias("_lo")).withColumns({"_k": F.row_number().over(order), "_hi": F.lead("_lo").over(order)})
    return ends.where((F.col("_k") % 2 == 1) & (F.col("_lo") < F.col("_hi"))).drop("_k")


def covered(cells: DataFrame, polygons: DataFrame, *keep: str, tile: float = 5.0) -> DataFrame:
    """(lat, lon, shape_no, keep): the cells whose centres each polygon(shape_no, rings, keep) holds.

    Shapes become stretches of the grid's rows; a stretch meets the cells of its row in the columns that it touches, by an equi-join.
    """
    column = lambda c: F.floor(c / tile)
    spans = spans_of(edges_of(polygons, *keep), axis_of(cells, "lat"), *keep, tile=tile)
    wide = spans.withColumn("_col", F.explode(F.sequence(column(F.col("_lo")), column(F.col("_hi")))))
    centres = cells.select("lat", "lon", column(F.col("lon")).alias("_col"))
    hits = centres.join(wide, ["lat", "_col"]).where((F.col("lon") >= F.col("_lo")) & (F.col("lon") < F.col("_hi")))
    return hits.select("lat", "lon", "shape_no", *keep)


def rasterize(cells: DataFrame, polygons: DataFrame, value: str, background: float = 0.0, missing: float = -9999.0, tile: float = 5.0) -> DataFrame:
    """Cells with the value of the last polygon(shape_no, rings, value) whose inside holds their centre."""
    last = covered(cells, polygons, value, tile=tile).groupBy("lat", "lon").agg(F.max_by(value, "shape_no").alias("_v"))
    v = F.coalesce(F.when(F.col("_v") != missing, F.col("_v")), F.lit(background))
    return cells.join(last, ["lat", "lon"], "left").withColumn(value, v).drop("_v")


def rasterize_attributes(cells: DataFrame, polygons: DataFrame, attributes: DataFrame, layers: list[str], values: list[str],
                         background: float = 0.0, missing: float = -9999.0, tile: float = 5.0) -> DataFrame:
    """A raster for each layer (crop, year) of attributes(shape_no, layers, values): one row a cell and layer.

    Which cells a shape holds is found once, whatever the number of layers.  In each layer the last shape that holds a cell and has attributes there
    wins; cells of none, and missing values, get the background.  The layers' names, a row a raster, go over the driver.
    """
    named = attributes.select(*layers).distinct().sort(*layers).collect()
    if not named:
        return cells.select("lat", "lon", *[F.lit(None).cast(attributes.schema[c].dataType).alias(c) for c in layers], *[F.lit(background).alias(v) for v in values]).limit(0)
    last = covered(cells, polygons, tile=tile).join(attributes, "shape_no").groupBy("lat", "lon", *layers).agg(F.max_by(F.struct(*values), "shape_no").alias("_v"))
    every = F.explode(F.array(*[F.struct(*[F.lit(r[c]).cast(attributes.schema[c].dataType).alias(c) for c in layers]) for r in named])).alias("_l")
    clean = [F.coalesce(F.when(F.col(f"_v.{v}") != missing, F.col(f"_v.{v}")), F.lit(background)).alias(v) for v in values]
    return cells.select("lat", "lon", every).select("lat", "lon", "_l.*").join(last, ["lat", "lon", *layers], "left").select("lat", "lon", *layers, *clean)
