"""Scalar features: cyclic encodings, month keys, differences, distances, guarded ratios."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.nulls import clean, row_mean, row_range, strict_max, strict_min

EARTH_KM = 6371.0
#: Reference point of the distances, in radians (about 52.225 N, 20.999 E).
ORIGIN = (0.9115, 0.3665)


def hour_of(c: str) -> Column:
    """Hour of a `YYYY-MM-DD HH...` string, null if it has none."""
    return F.substring(c, 12, 2).try_cast("double")


def month_key(c: str | Column) -> Column:
    """`YYYY_M`, the month without a leading zero."""
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    return F.concat(F.substring(s, 1, 4), F.lit("_"), F.regexp_replace(F.substring(s, 6, 2), "^0", ""))


def split_month(c: str) -> tuple[Column, Column]:
    parts = F.split(c, "_")
    return parts[0].cast("int"), parts[1].cast("int")


def cyclic(c: Column, period: float) -> tuple[Column, Column]:
    turn = F.lit(2 * math.pi / period)
    return F.cos(c * turn), F.sin(c * turn)


def distance_km(lat: str, lon: str, origin: tuple[float, float] = ORIGIN) -> Column:
    """Great-circle distance by the spherical law of cosines; degrees in, null if either is."""
    a, b = F.radians(F.col(lat)), F.radians(F.col(lon))
    cosine = F.sin(a) * math.sin(origin[0]) + F.cos(a) * math.cos(origin[0]) * F.cos(b - F.lit(origin[1]))
    return F.acos(strict_max(strict_min(cosine, F.lit(1.0)), F.lit(-1.0))) * EARTH_KM


def guarded_ratio(num: str, minuend: str, subtrahend: Column, floor: float = 1e-6) -> Column:
    return clean(num) / strict_max(clean(minuend) - subtrahend, F.lit(floor))


def telemetry_features(df: DataFrame, temperatures: list[str], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Month parts, cyclic month, radians, row-wise temperature mean and range, distance, load ratio, month keys of the device's type and of x3 (where those are given)."""
    present = [t for t in temperatures if t in df.columns]
    year, month = split_month("month_key")
    cos, sin = cyclic(month.cast("double"), 12)
    out = df.withColumns({"year": year, "month": month, "month_cos": cos, "month_sin": sin, "lat_rad": F.radians(lat), "lon_rad": F.radians(lon)})
    out = out.withColumns({"avg_temp": row_mean(*present), "temp_range": row_range(*present), "distance_km": distance_km(lat, lon)})
    out = out.withColumn("load_ratio", guarded_ratio("x1", "t1", F.col("avg_temp")))
    joined = lambda c: F.concat_ws("_", F.col(c).cast("string"), F.col("month").cast("string"))
    return out.withColumns({name: joined(c) for name, c in (("device_month", "deviceType"), ("curve_month", "x3")) if c in df.columns})
