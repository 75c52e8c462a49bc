"""Spherical geometry as Column functions: degrees in and out, metres for lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8  # fixed value: mean radius
MPH, KPH = 2.236936, 3.6  # fixed values: from metres a second


def normalized_bearing(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


def bearing_difference(a: Column, b: Column) -> Column:
    """The smaller angle between two bearings."""
    d = F.abs(normalized_bearing(a) - normalized_bearing(b))
    return F.least(d, F.lit(360.0) - d)


def is_coordinate(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0), F.lit(False)) & ~F.isnan(lat) & ~F.isnan(lon)


def is_null_island(lat: Column, lon: Column) -> Column:
    return (lat == 0) & (lon == 0)


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine of the central angle."""
    dy = F.sin(F.radians(lat2 - lat1) / 2)
    dx = F.sin(F.radians(lon2 - lon1) / 2)
    h = dy * dy + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dx * dx
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The bearing in which a great circle leaves the first point."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return normalized_bearing(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))))


def destination(lat: Column, lon: Column, degrees: Column, metres: Column) -> Column:
    """struct(lat, lon) of the point a bearing and a distance away."""
    a, t, arc = F.radians(lat), F.radians(degrees), metres / EARTH_RADIUS_M
    sine = F.sin(a) * F.cos(arc) + F.cos(a) * F.sin(arc) * F.cos(t)
    end = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine)))
    turn = F.atan2(F.sin(t) * F.sin(arc) * F.cos(a), F.cos(arc) - F.sin(a) * F.sin(end))
    return F.struct(F.degrees(end).alias("lat"), (F.pmod(lon + F.degrees(turn) + 180.0, F.lit(360.0)) - 180.0).alias("lon"))


def box_around(lat: Column, lon: Column, metres: Column) -> Column:
    """struct(south, west, north, east) that holds a circle; it ends at poles and the date line."""
    dy = F.degrees(metres / EARTH_RADIUS_M)
    cosine = F.cos(F.radians(lat))
    dx = F.when(cosine < 1e-9, F.lit(180.0)).otherwise(F.degrees(metres / (EARTH_RADIUS_M * cosine)))
    return F.struct(
        F.greatest(F.lit(-90.0), lat - dy).alias("south"),
        F.greatest(F.lit(-180.0), lon - dx).alias("west"),
        F.least(F.lit(90.0), lat + dy).alias("north"),
        F.least(F.lit(180.0), lon + dx).alias("east"),
    )


def box_holds(box: Column, lat: Column, lon: Column) -> Column:
    return lat.between(box["south"], box["north"]) & lon.between(box["west"], box["east"])


def box_center(box: Column) -> Column:
    return F.struct(((box["south"] + box["north"]) / 2).alias("lat"), ((box["west"] + box["east"]) / 2).alias("lon"))


def box_union(box: Column) -> Column:
    """Aggregate: the least box that holds all boxes; null over none."""
    return F.struct(F.min(box["south"]).alias("south"), F.min(box["west"]).alias("west"), F.max(box["north"]).alias("north"), F.max(box["east"]).alias("east"))


def _sides(ring: Column) -> Column:
    """Neighbouring points of a ring, the last with the first."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.element_at(ring, F.when(i + 2 > n, F.lit(1)).otherwise(i + 2)).alias("b")))


def in_polygon(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point is inside a ring of struct(x, y): a ray from it crosses the sides an odd number of times."""

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = (a["y"] > lat) != (b["y"] > lat)
        at = (b["x"] - a["x"]) * (lat - a["y"]) / F.when(spans, b["y"] - a["y"]) + a["x"]
        return F.coalesce(spans & (lon < at), F.lit(False))

    return F.size(F.filter(_sides(ring), crosses)) % 2 == 1


def polygon_area_m2(ring: Column) -> Column:
    """The area of a ring of struct(x, y) on the sphere; 0 for fewer than three points."""
    part = F.aggregate(
        _sides(ring),
        F.lit(0.0),
        lambda s, p: s + F.radians(p["b"]["x"] - p["a"]["x"]) * (F.lit(2.0) + F.sin(F.radians(p["a"]["y"])) + F.sin(F.radians(p["b"]["y"]))),
    )
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(part * (EARTH_RADIUS_M**2 / 2)))


def speed_mps(metres: Column, seconds: Column) -> Column:
    """Metres a second; null unless time passed."""
    return F.when(seconds > 0, metres / seconds)
