"""Planar geometry over doubles: points as (x, y), lines as array<struct<x, y>>, polygons as closed rings.

Lengths are in the unit of the coordinates. Everything here is column arithmetic, so it stays inside
generated code; buffers, as far as they only stood for a tolerance, become distance tests.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ellipsoid and projection centre of the European equal-area system (EPSG:3035).
_A, _F, _LAT0, _LON0, _FE, _FN = 6378137.0, 1 / 298.257222101, math.radians(52.0), math.radians(10.0), 4321000.0, 3210000.0
_E2 = 2 * _F - _F * _F
_E = math.sqrt(_E2)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def nearest_on_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column]:
    """(x, y, share of the segment) of the point of a segment that lies nearest to p."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / F.when(square == 0, 1.0).otherwise(square))))
    return x1 + t * dx, y1 + t * dy, t


def segments_cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    """(whether they cross, share of a, share of b) for segments (x1, y1, x2, y2); parallel ones do not cross."""
    ax, ay, bx, by = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    det = ax * by - ay * bx
    safe = F.when(det == 0, F.lit(1.0)).otherwise(det)
    t = ((b[0] - a[0]) * by - (b[1] - a[1]) * bx) / safe
    u = ((b[0] - a[0]) * ay - (b[1] - a[1]) * ax) / safe
    return (det != 0) & t.between(0, 1) & u.between(0, 1), t, u


def _pairs(line: Column) -> Column:
    return F.arrays_zip(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))).alias("a"), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))).alias("b"))


def line_length(line: Column) -> Column:
    return F.aggregate(_pairs(line), F.lit(0.0), lambda acc, s: acc + F.hypot(s["a"]["x"] - s["b"]["x"], s["a"]["y"] - s["b"]["y"]))


def ring_area(ring: Column) -> Column:
    """Area inside a closed ring, by the shoelace formula."""
    return F.abs(F.aggregate(_pairs(ring), F.lit(0.0), lambda acc, s: acc + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def ring_centroid(ring: Column) -> Column:
    """struct<x, y>; the mean of the corners where the area is 0."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc: Column, s: Column) -> Column:
        cross = s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
        return F.struct((acc["a"] + cross).alias("a"), (acc["x"] + (s["a"]["x"] + s["b"]["x"]) * cross).alias("x"), (acc["y"] + (s["a"]["y"] + s["b"]["y"]) * cross).alias("y"))

    def mean(k: str) -> Column:
        return F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[k]) / F.size(ring)

    whole = F.aggregate(_pairs(ring), start, step)
    return F.struct(F.when(whole["a"] == 0, mean("x")).otherwise(whole["x"] / (3 * whole["a"])).alias("x"), F.when(whole["a"] == 0, mean("y")).otherwise(whole["y"] / (3 * whole["a"])).alias("y"))


def inside_ring(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point lies inside a closed ring: an odd number of edges cross the ray to its right."""

    def crosses(s: Column) -> Column:
        (x1, y1), (x2, y2) = (s["a"]["x"], s["a"]["y"]), (s["b"]["x"], s["b"]["y"])
        span = F.when(y2 == y1, F.lit(1.0)).otherwise(y2 - y1)
        return ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / span + x1)

    return F.size(F.filter(_pairs(ring), crosses)) % 2 == 1


def bounds(line: Column) -> tuple[Column, Column, Column, Column]:
    """min x, min y, max x, max y."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def start_point(line: Column) -> Column:
    return F.element_at(line, 1)


def end_point(line: Column) -> Column:
    return F.element_at(line, -1)


def make_line(*points: Column) -> Column:
    return F.array(*points)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def wkt_point(p: Column) -> Column:
    return F.concat(F.lit("POINT("), p["x"].cast("string"), F.lit(" "), p["y"].cast("string"), F.lit(")"))


def wkt_line(line: Column) -> Column:
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(line, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ","), F.lit(")"))


def line_of_wkt(text: Column) -> Column:
    """Points of a POINT or LINESTRING text."""
    body = F.regexp_extract(text, r"\(([^()]*)\)", 1)
    return F.transform(F.split(body, r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")))


def azimuth(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Clockwise angle from north, in radians."""
    angle = F.atan2(x2 - x1, y2 - y1)
    return F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)))


def _q(sin: Column | float):
    if isinstance(sin, float):
        return (1 - _E2) * (sin / (1 - _E2 * sin * sin) - math.log((1 - _E * sin) / (1 + _E * sin)) / (2 * _E))
    return (1 - _E2) * (sin / (1 - _E2 * sin * sin) - F.log((1 - _E * sin) / (1 + _E * sin)) / (2 * _E))


_QP = _q(1.0)
_RQ = _A * math.sqrt(_QP / 2)
_BETA0 = math.asin(_q(math.sin(_LAT0)) / _QP)
_D = _A * math.cos(_LAT0) / math.sqrt(1 - _E2 * math.sin(_LAT0) ** 2) / (_RQ * math.cos(_BETA0))


def to_3035(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing (EPSG:3035) of geographic degrees: the Lambert azimuthal equal-area closed form."""
    beta, lam = F.asin(_q(F.sin(F.radians(lat))) / _QP), F.radians(lon) - _LON0
    b = _RQ * F.sqrt(2 / (1 + math.sin(_BETA0) * F.sin(beta) + math.cos(_BETA0) * F.cos(beta) * F.cos(lam)))
    x = _FE + b * _D * F.cos(beta) * F.sin(lam)
    return x, _FN + b / _D * (math.cos(_BETA0) * F.sin(beta) - math.sin(_BETA0) * F.cos(beta) * F.cos(lam))


def from_3035(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of EPSG:3035 metres."""
    u, v = (x - _FE) / _D, (y - _FN) * _D
    rho = F.hypot(u, v)
    c = 2 * F.asin(F.least(F.lit(1.0), rho / (2 * _RQ)))
    safe = F.when(rho == 0, 1.0).otherwise(rho)
    beta = F.when(rho == 0, F.lit(_BETA0)).otherwise(F.asin(F.cos(c) * math.sin(_BETA0) + v * F.sin(c) * math.cos(_BETA0) / safe))
    lam = F.atan2(u * F.sin(c), rho * math.cos(_BETA0) * F.cos(c) - v * math.sin(_BETA0) * F.sin(c))
    e4, e6 = _E2 * _E2, _E2**3
    lat = beta + (_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
    return F.degrees(F.when(rho == 0, 0.0).otherwise(lam) + _LON0), F.degrees(lat)
