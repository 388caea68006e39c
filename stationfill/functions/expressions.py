"""Column expressions: time codes, quality tests, wind as a vector."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from stationfill.functions.rules import RULES

EARTH_RADIUS_KM = 6371.0088
EPSILON = 2.0**-52


def is_finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def timestamp_of(date_code: Column, hour_code: Column) -> Column:
    """FECHA (YYYYMMDD) and HORA (HH0000) as a zoneless timestamp."""
    day = F.try_to_timestamp(F.lpad(date_code.cast("string"), 8, "0"), F.lit("yyyyMMdd")).cast("timestamp_ntz")
    return day + F.make_dt_interval(F.lit(0), F.floor(hour_code / 10000).cast("int"))


def date_code(ts: Column) -> Column:
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.day(ts)).cast("int")


def hour_code(ts: Column) -> Column:
    return (F.hour(ts) * 10000).cast("int")


def hard_invalid(raw: Column, variable: str) -> Column:
    """A value that can't be: not finite, or outside the hard bounds. Null isn't invalid."""
    low, high, _, _ = RULES[variable]
    bad = ~is_finite(raw)
    if low is not None:
        bad = bad | (raw < low)
    if high is not None:
        bad = bad | (raw > high)
    return raw.isNotNull() & F.coalesce(bad, F.lit(False))


def plausible(value: Column, variable: str) -> Column:
    return is_finite(value) & value.between(*RULES[variable][2:])


def operational_outlier(raw: Column, variable: str) -> Column:
    """A possible value outside the plausible range."""
    return is_finite(raw) & ~hard_invalid(raw, variable) & ~raw.between(*RULES[variable][2:])


def wind_u(direction: Column, speed: Column) -> Column:
    """Eastward component; the direction is where the wind comes from. Calm is 0 whatever the direction."""
    return F.when(speed == 0, F.lit(0.0)).otherwise(-speed * F.sin(F.radians(F.pmod(direction, F.lit(360.0)))))


def wind_v(direction: Column, speed: Column) -> Column:
    return F.when(speed == 0, F.lit(0.0)).otherwise(-speed * F.cos(F.radians(F.pmod(direction, F.lit(360.0)))))


def numerical_calm(speed: Column) -> Column:
    """Zero up to the rounding of floating point, not a light wind."""
    return F.coalesce(F.abs(speed) <= 16 * EPSILON * F.greatest(F.lit(1.0), F.abs(speed)), F.lit(False))


def speed_of(u: Column, v: Column) -> Column:
    speed = F.hypot(u, v)
    return F.when(numerical_calm(speed), F.lit(0.0)).otherwise(speed)


def direction_of(u: Column, v: Column) -> Column:
    """Degrees in [0, 360) where the wind comes from; null when calm."""
    angle = F.pmod(F.degrees(F.atan2(-u, -v)) + 360.0, F.lit(360.0))
    return F.when(~numerical_calm(F.hypot(u, v)), angle)


def valid_wind(u: Column, v: Column) -> Column:
    return is_finite(u) & is_finite(v) & F.coalesce(F.hypot(u, v) <= RULES["VEL_VIENTO"][3], F.lit(False))


def circular_mean(angle: Column) -> Column:
    """Aggregate: mean direction in degrees, null where the directions cancel out; next to 360 is 0."""
    s, c = F.avg(F.sin(F.radians(angle))), F.avg(F.cos(F.radians(angle)))
    mean = F.pmod(F.degrees(F.atan2(s, c)) + 360.0, F.lit(360.0))
    return F.when(F.hypot(s, c) > 1e-12, F.when(360.0 - mean <= 360.0 * 1e-5 + 1e-8, F.lit(0.0)).otherwise(mean))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine; null if a coordinate is."""
    d_lat, d_lon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(d_lat / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(d_lon / 2) ** 2
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def close_to(a: Column, b: Column) -> Column:
    """|a - b| <= 1e-8 + 1e-5 |b|."""
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


