"""Geometry on the sphere: points are structs (lon, lat) in degrees, polygons lists of points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean radius of the Earth in metres.
RADIUS = 6371008.8


def geo_point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle (haversine)."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return F.lit(2 * RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def geo_distance(a: Column, b: Column) -> Column:
    return distance(a["lat"], a["lon"], b["lat"], b["lon"])


def geo_in_range(a: Column, b: Column, low: float, high: float, with_low: bool = True, with_high: bool = True) -> Column:
    d = geo_distance(a, b)
    return (d >= low if with_low else d > low) & (d <= high if with_high else d < high)


def geo_contains(polygon: Column, point: Column) -> Column:
    """Whether a polygon (list of points, edges straight in degrees, closed by itself) holds a point: crossings of a ray."""
    n = F.size(polygon)
    x, y = point["lon"], point["lat"]

    def crosses(i: Column) -> Column:
        p, q = F.get(polygon, i), F.get(polygon, (i + 1) % n)
        at = p["lon"] + (y - p["lat"]) / F.when(q["lat"] != p["lat"], q["lat"] - p["lat"]) * (q["lon"] - p["lon"])
        return F.coalesce(((p["lat"] > y) != (q["lat"] > y)) & (x < at), F.lit(False))

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1


def box_intersects(a: Column, b: Column) -> Column:
    """Whether two boxes (structs west, south, east, north) share a point."""
    return (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])


def near(df: DataFrame, lat: str, lon: str, at: tuple[float, float], by: str, limit: int | None = 100, digits: int | None = None) -> DataFrame:
    """The rows nearest to a point (latitude, longitude) with their ``metres``, nearest first; ties by column ``by``.

    With ``digits``, metres are rounded before rows are ranked, so that rows of one rounded distance are ties.
    Each task keeps ``limit`` rows of its own before they meet.  Rows without a place are left out.
    """
    metres = distance(F.col(lat), F.col(lon), F.lit(at[0]), F.lit(at[1]))
    metres = metres if digits is None else F.round(metres, digits)
    out = df.withColumn("metres", metres).where("metres is not null").orderBy("metres", by)
    return out if limit is None else out.limit(limit)


def within(df: DataFrame, lat: str, lon: str, at: tuple[float, float], radius: float) -> DataFrame:
    """The rows within ``radius`` metres of a point (latitude, longitude), with their ``metres``.

    A circle's latitudes bound it, so that a scan can be pruned by them before distances are worked out.
    """
    reach = math.degrees(radius / RADIUS) + 1e-9
    rows = df.where(F.col(lat).between(at[0] - reach, at[0] + reach))
    return rows.withColumn("metres", distance(F.col(lat), F.col(lon), F.lit(at[0]), F.lit(at[1]))).where(F.col("metres") <= radius)
