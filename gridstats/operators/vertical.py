"""Level interpolation, layer thickness and moisture convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Target pressures in hPa and the earth's radius in m (fixed values).
PRESSURES = (1000, 925, 850, 700, 600, 500, 400, 300, 250, 200, 150, 100, 70, 50, 30, 20, 10)
RADIUS = 6_371_229.0


def hybrid_pressure(hyam: Column, hybm: Column, p0: Column, ps: Column) -> Column:
    return hyam * p0 + hybm * ps


def interp_levels(df: DataFrame, keys: list[str], p: str, value: str, targets: tuple[int, ...] = PRESSURES, extrapolate: bool = True) -> DataFrame:
    """value on target pressures (hPa; lev in Pa), linear in p within each column.

    Beyond the ends the two outermost levels are extended (below ground only if extrapolate).
    """
    w = Window.partitionBy(*keys).orderBy(p)
    seg = df.where(F.col(p).isNotNull() & F.col(value).isNotNull()).select(
        *keys, F.col(p).alias("_p0"), F.lead(p).over(w).alias("_p1"), F.col(value).alias("_v0"), F.lead(value).over(w).alias("_v1"),
        F.row_number().over(w).alias("_i"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"),
    ).where("_p1 IS NOT NULL AND _p1 > _p0")
    first, last = F.col("_i") == 1, F.col("_i") == F.col("_n") - 1
    inside = lambda t: ((t >= F.col("_p0")) | first) & ((t < F.col("_p1")) | (last & (F.lit(extrapolate) | (t <= F.col("_p1")))))
    levels = F.array(*[F.lit(float(t * 100)) for t in targets])
    hit = seg.select("*", F.explode(F.filter(levels, inside)).alias("lev"))  # a row for each target of the segment, none for the others
    frac = (F.col("lev") - F.col("_p0")) / (F.col("_p1") - F.col("_p0"))
    return hit.select(*keys, "lev", (F.col("_v0") + frac * (F.col("_v1") - F.col("_v0"))).alias(value))


def layer_thickness(df: DataFrame, keys: list[str], lev: str, psfc: str, ptop: float, tol: float = 0.001) -> DataFrame:
    """Adds dp: pressure thickness of levels between midpoints, cut at ptop and the surface.

    Levels outside are NULL; all are NULL where the surface is not below ptop or the sum is off.
    """
    w = Window.partitionBy(*keys).orderBy(lev)
    up, down = F.lag(lev).over(w), F.lead(lev).over(w)
    top = F.greatest(F.coalesce((up + F.col(lev)) / 2, F.lit(float(ptop))), F.lit(float(ptop)))
    bottom = F.least(F.coalesce((down + F.col(lev)) / 2, F.col(psfc)), F.col(psfc))
    dp = df.withColumn("_t", top).withColumn("_b", bottom).withColumn("dp", F.when(F.col("_b") > F.col("_t"), F.col("_b") - F.col("_t")))
    total = F.sum("dp").over(Window.partitionBy(*keys))
    good = (F.col(psfc) > ptop) & (F.abs(total - (F.col(psfc) - ptop)) <= tol)
    return dp.withColumn("dp", F.when(good, F.col("dp"))).drop("_t", "_b")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(a), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(b), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def convergence(df: DataFrame, keys: list[str], fx: str, fy: str) -> DataFrame:
    """Adds conv = -(d fx/dx + d fy/dy): centred differences, one-sided at the borders."""
    along_x = Window.partitionBy(*keys, "lat").orderBy("lon")
    along_y = Window.partitionBy(*keys, "lon").orderBy("lat")

    def slope(f: str, axis: str, w) -> Column:  # noqa: ANN001
        near = lambda step: (lambda c: F.coalesce(step(c).over(w), F.col(c)))
        lo, hi = near(F.lag), near(F.lead)
        if axis == "lon":
            d = haversine(F.col("lat"), lo("lon"), F.col("lat"), hi("lon"))
        else:
            d = haversine(lo("lat"), F.col("lon"), hi("lat"), F.col("lon"))
        return F.try_divide(hi(f) - lo(f), d)

    return df.withColumn("_dx", slope(fx, "lon", along_x)).withColumn("_dy", slope(fy, "lat", along_y)).withColumn(
        "conv", -(F.col("_dx") + F.col("_dy"))
    ).drop("_dx", "_dy")
