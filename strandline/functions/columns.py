"""Scalar column functions: time, missing values, angles, geometry, text rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NS = 1_000_000_000
#: Mean Earth radius in metres: fixed value.
EARTH_M = 6_371_000.0


def finite(x: Column) -> Column:
    """NULL for NaN and infinities: missing is NULL everywhere."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def with_finite(df: DataFrame) -> DataFrame:
    """All DOUBLE and FLOAT columns through ``finite``."""
    return df.withColumns({c: finite(F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def seconds(ns: Column) -> Column:
    return ns / NS


def to_ns(s: float) -> int:
    return int(round(s * NS))


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; NULL stays NULL (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def seconds_to_samples(s: Column, rate: Column, least: int = 1) -> Column:
    """Half-even rounded s * rate, at least ``least``."""
    return F.greatest(F.lit(least), F.rint(s * rate).cast("long"))


def wrap_degrees(x: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def project_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Equirectangular metres east and north of an origin."""
    step = math.pi / 180 * EARTH_M
    return (lon - lon0) * F.cos(F.radians(lat0)) * step, (lat - lat0) * step


def unproject_xy(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    step = math.pi / 180 * EARTH_M
    return lat0 + y / step, lon0 + x / (F.cos(F.radians(lat0)) * step)


def segment_projection(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """(distance, t) of a point to a segment, t clamped to [0, 1] and 0 for a segment without length."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(clip(ratio((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), 0, 1), F.lit(0.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy)), t


def menger(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Curvature of the circle through three points: 0 where two of them coincide, NULL where one is NULL."""
    area2 = F.abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
    sides = F.hypot(bx - ax, by - ay) * F.hypot(cx - bx, cy - by) * F.hypot(cx - ax, cy - ay)
    return F.when(area2.isNotNull(), F.coalesce(F.try_divide(2 * area2, sides), F.lit(0.0)))


def turn_deg(a: Column, b: Column) -> Column:
    """Angle between two directions, 0 to 180."""
    return F.abs(wrap_degrees(a - b))


def circular_mean_deg(angle: Column) -> Column:
    """Aggregate: mean direction in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(angle))), F.avg(F.cos(F.radians(angle))))), F.lit(360.0))


def entropy(shares: Column, over: Column) -> Column:
    """-sum p ln p over an ARRAY of shares, divided by ln of ``over`` (0 where that is 1 or less)."""
    raw = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.ln(p)).otherwise(0.0))
    return F.when(over > 1, raw / F.ln(over)).otherwise(0.0)


def first_reason(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Name of the first rule that holds."""
    out = F.when(F.lit(False), "")
    for holds, name in rules:
        out = out.when(holds, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def all_reasons(rules: list[tuple[Column, str]]) -> Column:
    """Names of all rules that hold, joined by '; '; NULL if none does."""
    return F.nullif(F.array_join(F.array_compact(F.array(*[F.when(holds, F.lit(name)) for holds, name in rules])), "; "), F.lit(""))


def reason_bits(rules: list[Column]) -> Column:
    """Bit mask: bit i for rule i."""
    out = F.lit(0)
    for i, holds in enumerate(rules):
        out = out.bitwiseOR(F.when(holds, F.lit(1 << i)).otherwise(F.lit(0)))
    return out


def max_speed_kph(tag: Column) -> Column:
    """'50', '30 mph' to km/h; NULL where it isn't a number."""
    number = F.nullif(F.regexp_extract(tag, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
    return F.when(F.lower(tag).contains("mph"), number * 1.609344).otherwise(number)


def percent_of(value: Column, base: Column) -> Column:
    """Difference in percent of the base; NULL where the base is practically zero."""
    return F.when(F.abs(base) > 1e-12, 100 * (value - base) / F.abs(base))


def assert_public(df: DataFrame, banned: tuple[str, ...] = ("latitude", "longitude", "lat", "lon", "altitude", "utc")) -> DataFrame:
    """df itself; an error if a column name holds a banned word (case doesn't matter)."""
    found = [c for c in df.columns if any(part in banned for part in c.lower().split("_"))]
    if found:
        raise ValueError(f"columns that must not be published: {found}")
    return df
