"""Distances on the WGS-84 spheroid with native functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
DEFAULT_RADIUS, MAX_RADIUS, MOST = 1000.0, 50_000.0, 50


def distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres by Lambert's formula for long lines; 0 for equal points."""
    b1, b2 = (F.atan((1 - FLATTENING) * F.tan(F.radians(x))) for x in (lat1, lat2))
    half = lambda x: F.pow(F.sin(x / 2), 2.0)
    h = half(b2 - b1) + F.cos(b1) * F.cos(b2) * half(F.radians(lng2) - F.radians(lng1))
    sigma = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (sigma - F.sin(sigma)) * F.pow(F.sin(p) * F.cos(q) / F.cos(sigma / 2), 2.0)
    y = (sigma + F.sin(sigma)) * F.pow(F.cos(p) * F.sin(q) / F.sin(sigma / 2), 2.0)
    return F.when(sigma == 0, 0.0).otherwise(AXIS * (sigma - FLATTENING / 2 * (x + y)))


def point(lat: Column, lng: Column) -> Column:
    """(lng, lat) if both are there."""
    return F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lng.alias("lng"), lat.alias("lat")))


def box(lat: float, lng: float, radius: float) -> tuple[float, float, float, float]:
    """Latitudes and longitudes that hold every point within ``radius``; the scan can prune by them."""
    dlat = radius / 110_000.0
    widest = min(89.9, abs(lat) + dlat)
    dlng = min(360.0, radius / (111_000.0 * math.cos(math.radians(widest))))
    return lat - dlat, lat + dlat, lng - dlng, lng + dlng


def checked(lat, lng, radius=None) -> tuple[float, float, float]:
    """Search arguments as numbers, within their ranges."""
    lat, lng = float(lat), float(lng)
    radius = DEFAULT_RADIUS if radius is None else float(radius)
    if not (-90 <= lat <= 90 and -180 <= lng <= 180 and 0 < radius <= MAX_RADIUS):
        raise ValueError("latitude, longitude or radius is out of range")
    return lat, lng, radius


def camel(df: DataFrame) -> DataFrame:
    """Rows of a search as clients get them: camel-case names, the amount as a number."""
    named = {c: (w := c.split("_"))[0] + "".join(map(str.title, w[1:])) for c in df.columns}
    return df.withColumn("amount", F.col("amount").cast("double")).withColumnsRenamed(named)


def nearby(df: DataFrame, lat, lng, radius=None, most: int = MOST) -> DataFrame:
    """Rows within ``radius`` metres, nearest first, ``most`` at the most; ``distance_meters`` is rounded to cents."""
    lat, lng, radius = checked(lat, lng, radius)
    south, north, west, east = box(lat, lng, radius)
    near = df.where(F.col("latitude").between(south, north))
    if west >= -180 and east <= 180:
        near = near.where(F.col("longitude").between(west, east))
    exact = near.withColumn("__m", distance(F.lit(lat), F.lit(lng), F.col("latitude"), F.col("longitude"))).where(F.col("__m") <= radius)
    exact = exact.orderBy("__m", "id").limit(most)
    return exact.withColumn("distance_meters", F.floor(F.col("__m") * 100 + 0.5) / 100).drop("__m")
