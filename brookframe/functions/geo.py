"""Geometry: points and polygons as structs; distances and containment as column expressions.

A point is {x, y}; a polygon is an array of points, its ring, closed or not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the mean radius of the earth in metres.
EARTH_RADIUS = 6371008.8


def point(x: Column | float, y: Column | float) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for v, n in ((x, "x"), (y, "y"))])


def polygon(ring: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[point(x, y) for x, y in ring])


def bbox_polygon(x0: float, y0: float, x1: float, y1: float) -> Column:
    return polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])


def distance(a: Column, b: Column) -> Column:
    """Planar, of points."""
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def distance_sphere(a: Column, b: Column) -> Column:
    """Metres along a great circle; x is longitude and y latitude, in degrees."""
    p, q = F.radians(a["y"]), F.radians(b["y"])
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(b["x"] - a["x"]) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def dwithin(a: Column, b: Column, d: float) -> Column:
    return distance(a, b) <= d


def _edges(ring: Column) -> Column:
    """Pairs of neighbouring points; the last joins the first."""
    return F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.array_size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def contains(ring: Column, p: Column) -> Column:
    """Whether a polygon contains a point: a ray to the right crosses its edges an odd number of times."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straddles = (a["y"] > p["y"]) != (b["y"] > p["y"])
        at = a["x"] + F.try_divide((p["y"] - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return straddles & (p["x"] < F.coalesce(at, a["x"]))

    return F.array_size(F.filter(_edges(ring), crosses)) % 2 == 1


def within(p: Column, ring: Column) -> Column:
    return contains(ring, p)


def _bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def intersects_bbox(r: Column, s: Column) -> Column:
    """Whether the bounding boxes of two polygons meet."""
    ax, ay, bx, by = _bounds(r)
    cx, cy, dx, dy = _bounds(s)
    return (ax <= dx) & (cx <= bx) & (ay <= dy) & (cy <= by)


def intersects(r: Column, s: Column) -> Column:
    """Whether two polygons meet: edges cross, or one contains the other's first point."""

    def side(a: Column, b: Column, c: Column) -> Column:
        return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def meets(e: Column, f: Column) -> Column:
        return (side(e["a"], e["b"], f["a"]) * side(e["a"], e["b"], f["b"]) <= 0) & (side(f["a"], f["b"], e["a"]) * side(f["a"], f["b"], e["b"]) <= 0)

    crossing = F.exists(_edges(r), lambda e: F.exists(_edges(s), lambda f: meets(e, f)))
    return intersects_bbox(r, s) & (crossing | contains(r, s[0]) | contains(s, r[0]))
