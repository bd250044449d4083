"""Geometry in Column expressions: points are two doubles, lines and rings are arrays of struct<x, y>."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and the third-order series of the transverse Mercator projection
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
_BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, _N**2 / 48 + _N**3 / 15, 17 / 480 * _N**3)
_DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3, 7 / 3 * _N**2 - 8 / 5 * _N**3, 56 / 15 * _N**3)
_SCALE, _EAST, _MERIDIAN = 0.9996, 500_000.0, -75.0


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north in UTM zone 18N."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    sin = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin) - e * F.atanh(e * sin))
    along = F.radians(lon - _MERIDIAN)
    xi, eta = F.atan2(t, F.cos(along)), F.atanh(F.sin(along) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _EAST + _SCALE * _R * x, _SCALE * _R * y


def from_utm(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude."""
    xi, eta = y / (_SCALE * _R), (x - _EAST) / (_SCALE * _R)
    xi_, eta_ = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi_ = xi_ - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_ = eta_ - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_) / F.cosh(eta_))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return _MERIDIAN + F.degrees(F.atan2(F.sinh(eta_), F.cos(xi_))), F.degrees(lat)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def line_to_utm(line: Column) -> Column:
    def moved(p):
        x, y = to_utm(p["x"], p["y"])
        return point(x, y)

    return F.transform(line, moved)


def segments(line: Column) -> Column:
    """array<struct<a, b>> of a line's legs."""
    heads = F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0)))
    return F.transform(heads, lambda p, i: F.struct(p.alias("a"), F.get(line, i + 1).alias("b")))


def _leg(s: Column) -> Column:
    return F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])


def length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda acc, s: acc + _leg(s))


def locate(line: Column, x: Column, y: Column) -> Column:
    """Where along ``line`` (0 to 1) its nearest point to x, y lies; struct<distance, fraction>."""
    start = F.struct(F.lit(0.0).alias("done"), F.lit(float("inf")).alias("distance"), F.lit(0.0).alias("at"))

    def step(acc, s):
        ax, ay = s["a"]["x"], s["a"]["y"]
        dx, dy = s["b"]["x"] - ax, s["b"]["y"] - ay
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.least(F.greatest(((x - ax) * dx + (y - ay) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        away = F.hypot(x - ax - t * dx, y - ay - t * dy)
        closer = away < acc["distance"]
        return F.struct((acc["done"] + _leg(s)).alias("done"), F.when(closer, away).otherwise(acc["distance"]).alias("distance"), F.when(closer, acc["done"] + t * _leg(s)).otherwise(acc["at"]).alias("at"))

    return F.aggregate(segments(line), start, step, lambda acc: F.struct(acc["distance"].alias("distance"), F.when(acc["done"] > 0, acc["at"] / acc["done"]).otherwise(0.0).alias("fraction")))


def interpolate(line: Column, fraction: Column) -> Column:
    """The point at ``fraction`` of a line's length."""
    want = fraction * length(line)
    first = F.get(line, F.lit(0))
    start = F.struct(F.lit(0.0).alias("done"), first["x"].cast("double").alias("x"), first["y"].cast("double").alias("y"))

    def step(acc, s):
        leg = _leg(s)
        t = F.when(leg > 0, F.least(F.lit(1.0), (want - acc["done"]) / leg)).otherwise(0.0)
        on = want >= acc["done"]
        return F.struct((acc["done"] + leg).alias("done"), F.when(on, s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"])).otherwise(acc["x"]).alias("x"), F.when(on, s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])).otherwise(acc["y"]).alias("y"))

    return F.aggregate(segments(line), start, step, lambda acc: point(acc["x"], acc["y"]))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether x, y is inside a closed ring, by crossings of a ray to the right."""

    def crosses(s):
        ay, by = s["a"]["y"], s["b"]["y"]
        at = s["a"]["x"] + (y - ay) / F.nullif(by - ay, F.lit(0.0)) * (s["b"]["x"] - s["a"]["x"])
        return F.coalesce(((ay > y) != (by > y)) & (x < at), F.lit(False)).cast("int")

    return F.aggregate(segments(ring), F.lit(0), lambda acc, s: acc + crosses(s)) % 2 == 1


def bounds(ring: Column) -> list[Column]:
    return [F.array_min(F.transform(ring, lambda p: p["x"])), F.array_min(F.transform(ring, lambda p: p["y"])), F.array_max(F.transform(ring, lambda p: p["x"])), F.array_max(F.transform(ring, lambda p: p["y"]))]


def centroid(ring: Column) -> Column:
    """Area centroid of a closed ring."""
    start = F.struct(*[F.lit(0.0).alias(k) for k in ("a", "x", "y")])

    def step(acc, s):
        cross = s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
        return F.struct((acc["a"] + cross).alias("a"), (acc["x"] + (s["a"]["x"] + s["b"]["x"]) * cross).alias("x"), (acc["y"] + (s["a"]["y"] + s["b"]["y"]) * cross).alias("y"))

    return F.aggregate(segments(ring), start, step, lambda acc: point(acc["x"] / (3 * acc["a"]), acc["y"] / (3 * acc["a"])))
