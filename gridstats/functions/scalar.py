"""Column functions: units, humidity, degree days, areas, calendar and text helpers.

NULL in gives NULL out.  Built-in expressions throughout, so plans stay in the JVM.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from numpy.polynomial import legendre
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Barometric and vapour-pressure constants (fixed values).
STANDARD_HPA, HEIGHT_EXPONENT, SCALE_HEIGHT = 1013.25, -1.602769777072154, 10000.0
WARM_K, BASE_K, STANDARD_K = 213.15, 75.0, 288.15
ES0, ES_A, ES_B = 6.1078, 17.3, 237.3
EPSILON = 0.622
POLAR_KM, EQUATOR_KM = 6356.7523, 6378.137
#: Samples of a day's sine, and how near a sample must be to a temperature to count as on it (degrees).
SAMPLES, ON_IT = 200, 1e-9


def guarded(value: Column, *inputs: Column) -> Column:
    """value, or NULL where any input is NULL (greatest and least skip NULL)."""
    ok = F.lit(True)
    for c in inputs:
        ok = ok & c.isNotNull()
    return F.when(ok, value)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def pressure_from_height(z: Column) -> Column:
    """Standard-atmosphere pressure (hPa) at height z (m)."""
    return STANDARD_HPA * F.exp(HEIGHT_EXPONENT * F.log((F.exp(z / SCALE_HEIGHT) * WARM_K + BASE_K) / STANDARD_K))


def saturation_vp(t: Column) -> Column:
    """Saturation vapour pressure (hPa) at t degrees Celsius."""
    return ES0 * F.exp(F.try_divide(ES_A * t, ES_B + t))


def mean_saturation_vp(tmax: Column, tmin: Column) -> Column:
    return (saturation_vp(tmax) + saturation_vp(tmin)) / 2


def mixing_ratio(q: Column) -> Column:
    return F.try_divide(q, 1 - q)


def vapour_pressure(q: Column, p: Column) -> Column:
    r = mixing_ratio(q)
    return F.try_divide(r * p, EPSILON + r)


def rel_humidity(e: Column, es: Column) -> Column:
    return F.try_divide(100 * e, es)


def vpd(es: Column, e: Column) -> Column:
    """Vapour pressure deficit, not below zero."""
    return guarded(F.greatest(es - e, F.lit(0.0)), es, e)


def clamp(x: Column, lo: float | None, hi: float | None) -> Column:
    """x within [lo, hi]; missing stays missing."""
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return guarded(out, x)


def _samples_from(tmin: Column, tmax: Column, t: Column) -> Column:
    """How many of a day's sine samples are at t or above; those within ON_IT of t count.

    Samples are at angles 2 pi i / SAMPLES, so those above a level are neighbours around the top: an arc sine counts them.
    """
    half = F.abs(tmax - tmin) / 2
    level = F.try_divide(t - ON_IT - (tmax + tmin) / 2, half)
    side = F.asin(F.greatest(F.least(level, F.lit(1.0)), F.lit(-1.0))) * (SAMPLES / 2 / math.pi)
    some = F.floor(SAMPLES / 2 - side) - F.ceil(side) + 1
    flat = F.when((tmax + tmin) / 2 >= t - ON_IT, SAMPLES).otherwise(0)
    return F.when(half == 0, flat).when(level > 1, 0).when(level <= -1, SAMPLES).otherwise(some).cast("double")


def sine_degree_days(tmin: Column, tmax: Column, t0: Column) -> Column:
    """Degree days above t0 of a day whose temperature is a sine between its extremes: the mean over its samples.

    k samples around the top sum to sin(k pi / SAMPLES) / sin(pi / SAMPLES) of the half range.
    """
    k = _samples_from(tmin, tmax, t0)
    top = F.sin(k * (math.pi / SAMPLES)) / math.sin(math.pi / SAMPLES)
    total = k * ((tmax + tmin) / 2 - t0) + F.abs(tmax - tmin) / 2 * top
    return guarded(F.greatest(total, F.lit(0.0)) / SAMPLES, tmin, tmax, t0)


def sine_exposure(tmin: Column, tmax: Column, t0: Column) -> Column:
    """Share of the day between t0 and t0 + 1, both included; a sample within ON_IT of a bound is on it."""
    return guarded((_samples_from(tmin, tmax, t0) - _samples_from(tmin, tmax, t0 + 1 + 2 * ON_IT)) / SAMPLES, tmin, tmax, t0)


def pixel_area(lat: Column, dlat: Column, dlon: Column) -> Column:
    """km2 of a cell of dlat x dlon degrees around lat."""
    return (2 * math.pi * POLAR_KM * dlat / 360) * (2 * math.pi * EQUATOR_KM * F.cos(F.radians(lat)) * dlon / 360)


def percent_diff(a: Column, b: Column) -> Column:
    return F.try_divide(100 * (a - b), b)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _gamma_step(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): twenty steps of the recurrence, then the series for large arguments."""
    z = a + 20
    tail = F.lit(0.0)
    for c in (39325 / 33554432, 869 / 4194304, -399 / 262144, -21 / 32768, 5 / 1024, 1 / 128, -1 / 8, 1.0):
        tail = tail / z + c
    down = F.aggregate(F.array(*[F.lit(float(k)) for k in range(20)]), F.lit(1.0), lambda p, k: p * (a + k) / (a + k + 0.5))
    return F.sqrt(z) * tail * down


def student_t_pvalue(t: Column, df: Column | int) -> Column:
    """Two-sided p of Student's t: the integral of cos^(df-1) over its angle, by 32 Gauss nodes whatever the degrees of freedom."""
    n = (df if isinstance(df, Column) else F.lit(df)).cast("double")
    # Beyond `far` the integrand is under 1e-17 of its peak.
    far = F.atan(F.sqrt(F.exp(F.try_divide(F.lit(78.0), n - 1)) - 1))
    half = F.least(F.atan(F.abs(t) / F.sqrt(n)), F.when(n > 1, far)) / 2
    nodes = F.array(*[F.struct(F.lit(float(x) + 1).alias("x"), F.lit(float(w)).alias("w")) for x, w in zip(*legendre.leggauss(32), strict=True)])

    def add(total: Column, node: Column) -> Column:
        tan = F.tan(half * node["x"])
        return total + node["w"] * F.exp((1 - n) / 2 * F.log1p(tan * tan))

    inside = F.aggregate(nodes, F.lit(0.0), add) * half * 2 / math.sqrt(math.pi) * _gamma_step(n / 2)
    return guarded(F.greatest(F.least(1 - inside, F.lit(1.0)), F.lit(0.0)), t, n)


def noleap_doy(day: Column) -> Column:
    """Day of the year without Feb 29 (which itself counts as Feb 28)."""
    leap = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31))) == 366
    return F.dayofyear(day) - F.when(leap & (F.dayofyear(day) >= 60), 1).otherwise(0)


def noleap_day(day: Column) -> Column:
    """Running day number of a calendar without leap days."""
    return (F.year(day) * 365 + noleap_doy(day) - 1).cast("long")


def noleap_date(number: Column) -> Column:
    """The date of a running no-leap day number."""
    year = F.floor(number / 365).cast("int")
    doy = (number - year.cast("long") * 365).cast("int")  # from 0
    leap = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy + F.when(leap & (doy >= 59), 1).otherwise(0))


def noleap_add_days(day: Column, n: int) -> Column:
    return noleap_date(noleap_day(day) + n)


def original_name(name: Column) -> Column:
    """PRECC,PRECL is PRECT; a trailing ',PS' goes; others stay."""
    return F.when(name == "PRECC,PRECL", "PRECT").otherwise(F.regexp_replace(name, ",PS$", ""))


def convert_flux(value: Column, units: Column, exponent: int = 1) -> Column:
    """kg m-2 s-1 to m/s (exponent 2 for variances); other units are left."""
    return F.when(units == "kg m-2 s-1", value * (0.001**exponent)).otherwise(value)


def precip_mm_day(value: Column, units: Column) -> Column:
    """Rain in mm a day from m/s or kg m-2 s-1; other units raise."""
    return (
        F.when(units == "m/s", value * 86_400_000.0).when(units == "kg m-2 s-1", value * 86_400.0)
        .otherwise(F.raise_error(F.concat(F.lit("unknown rain unit: "), units)).cast("double"))
    )


def kelvin_to_celsius(t: Column) -> Column:
    return t - 273.15


def lon_to_180(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


def lon_to_360(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360).otherwise(lon)


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").when(month.isin(9, 10, 11), "SON")
    )


def threshold_mask(x: Column, low: float) -> Column:
    """x where it reaches low."""
    return F.when(x >= low, x)


def near_zero_mask(x: Column, eps: float = 1e-12) -> Column:
    return F.when(F.abs(x) > eps, x)


def run_part(name: Column, part: int) -> Column:
    """1: what stands before the last underscore, 2: what stands after it."""
    return F.regexp_extract(name, "^(.*)_([^_]*)$", part)
