"""Planar geometry as Column expressions.

A ring or line is an array of struct(x, y). Everything here stays inside the JVM; nothing needs a geometry library.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_000.0
#: Segments of a buffer's outline: 16 a quarter.
SEGMENTS = 64
#: Area of a buffer of radius 1.
UNIT_BUFFER_AREA = SEGMENTS / 2 * math.sin(2 * math.pi / SEGMENTS)
EARTH_RADIUS = 6_378_137.0


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def bounds_polygon(minx, miny, maxx, maxy) -> Column:
    """The ring of a box, clockwise from its lower left corner, closed."""
    a, b, c, d = map(_c, (minx, miny, maxx, maxy))
    return F.array(point(a, b), point(a, d), point(c, d), point(c, b), point(a, b))


def _edges(ring: Column) -> Column:
    """Pairs of consecutive points."""
    head = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    tail = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.zip_with(head, tail, lambda p, q: F.struct(p.x.alias("x"), p.y.alias("y"), q.x.alias("u"), q.y.alias("v")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def line_length(line: Column) -> Column:
    return _sum(F.transform(_edges(line), lambda e: F.hypot(e.u - e.x, e.v - e.y)))


def signed_area(ring: Column) -> Column:
    """Half the cross products of a closed ring; negative if clockwise."""
    return _sum(F.transform(_edges(ring), lambda e: e.x * e.v - e.u * e.y)) / 2


def polygon_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """Of a closed ring by its area; of a point or a flat ring the mean of its points."""
    a6 = signed_area(ring) * 6
    cx = _sum(F.transform(_edges(ring), lambda e: (e.x + e.u) * (e.x * e.v - e.u * e.y)))
    cy = _sum(F.transform(_edges(ring), lambda e: (e.y + e.v) * (e.x * e.v - e.u * e.y)))
    n = F.greatest(F.size(ring), F.lit(1))
    flat = point(_sum(F.transform(ring, lambda p: p.x)) / n, _sum(F.transform(ring, lambda p: p.y)) / n)
    return F.when(F.coalesce(a6, F.lit(0.0)) != 0, point(cx / F.nullif(a6, F.lit(0.0)), cy / F.nullif(a6, F.lit(0.0)))).otherwise(flat)


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _clipped(ring: Column, inside, cross) -> Column:
    """A closed ring's part on one side of a line: inside(point), and where an edge (p, q) meets the line."""
    empty = F.array().cast("array<struct<x:double,y:double>>")

    def step(e):
        p, q = F.struct(e.x.alias("x"), e.y.alias("y")), F.struct(e.u.alias("x"), e.v.alias("y"))
        enters = F.when(inside(p) & inside(q), F.array(q)).when(inside(p), F.array(cross(p, q))).when(inside(q), F.array(cross(p, q), q))
        return F.coalesce(enters, empty)

    return let(let(ring, lambda r: F.flatten(F.transform(_edges(r), step))), lambda o: F.concat(o, F.slice(o, 1, 1)))


def clip_to_box(ring: Column, minx, miny, maxx, maxy) -> Column:
    """The closed ring of what a polygon without holes has in common with a box, side by side; its area is right where the
    common part falls apart, as the pieces are then joined by edges along the box."""
    x = lambda v: (lambda p, q: F.struct(v.alias("x"), (p.y + (q.y - p.y) * (v - p.x) / F.nullif(q.x - p.x, F.lit(0.0))).alias("y")))
    y = lambda v: (lambda p, q: F.struct((p.x + (q.x - p.x) * (v - p.y) / F.nullif(q.y - p.y, F.lit(0.0))).alias("x"), v.alias("y")))
    a, b, c, d = (_c(v).cast("double") for v in (minx, miny, maxx, maxy))
    for inside, cross in ((lambda p: p.x >= a, x(a)), (lambda p: p.x <= c, x(c)), (lambda p: p.y >= b, y(b)), (lambda p: p.y <= d, y(d))):
        ring = _clipped(ring, inside, cross)
    return ring


def bounds(ring: Column) -> list[Column]:
    """minx, miny, maxx, maxy."""
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def geometry_centroid(geometry: Column) -> Column:
    """Of struct(gtype, rings, parts): polygons by area, holes taken off; lines by length; points, and what has no extent, by their mean.

    parts are the places of the rings that begin a part: the others of a polygon are its holes."""
    rings, kind = geometry.rings, geometry.gtype
    total = lambda a: F.aggregate(a, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("w")), lambda s, v: F.struct((s.x + v.x * v.w).alias("x"), (s.y + v.y * v.w).alias("y"), (s.w + v.w).alias("w")))
    weighed = lambda p, w: F.struct(p.x.alias("x"), p.y.alias("y"), w.alias("w"))
    area = lambda r, i: weighed(centroid(r), polygon_area(r) * F.when(F.array_contains(geometry.parts, i), 1.0).otherwise(-1.0))
    middle = lambda r: F.transform(_edges(r), lambda e: F.struct(((e.x + e.u) / 2).alias("x"), ((e.y + e.v) / 2).alias("y"), F.hypot(e.u - e.x, e.v - e.y).alias("w")))
    each = F.transform(F.flatten(rings), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), F.lit(1.0).alias("w")))
    chosen = F.when(kind.endswith("Polygon"), total(F.transform(rings, area))).when(kind.endswith("LineString"), total(F.flatten(F.transform(rings, middle))))
    chosen = F.when(chosen.w > 0, chosen).otherwise(total(each))
    return F.when(chosen.w > 0, F.struct((chosen.x / chosen.w).alias("x"), (chosen.y / chosen.w).alias("y")))


def within_polygon(x, y, ring: list[tuple[float, float]]) -> Column:
    """Strictly inside a ring given by its corners: odd number of crossings, and on no edge."""
    x, y = _c(x), _c(y)
    pts = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    crossings, on = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(pts, pts[1:], strict=False):
        if ay != by:
            crosses = (F.lit(ay) > y) != (F.lit(by) > y)
            at = F.lit(float(ax)) + (y - ay) * ((bx - ax) / (by - ay))
            crossings = crossings + F.when(crosses & (x < at), 1).otherwise(0)
        cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        on = on | ((cross == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    return box & (crossings % 2 == 1) & ~on


def within_ring(x, y, ring: Column) -> Column:
    """Crossing number for a ring that is a column; points on an edge may be either."""
    x, y = _c(x), _c(y)
    n = F.aggregate(_edges(ring), F.lit(0), lambda a, e: a + F.when(((e.y > y) != (e.v > y)) & (x < e.x + (y - e.y) * (e.u - e.x) / F.nullif(e.v - e.y, F.lit(0.0))), 1).otherwise(0))
    return n % 2 == 1


def in_box(x, y, minx: float, miny: float, maxx: float, maxy: float) -> Column:
    """Boundary included; four comparisons that reach the scan."""
    x, y = _c(x), _c(y)
    return (x >= minx) & (x <= maxx) & (y >= miny) & (y <= maxy)


def boxes_overlap(minx: float, miny: float, maxx: float, maxy: float) -> Column:
    """For rows with their own box in columns minx, miny, maxx, maxy."""
    return (F.col("minx") <= maxx) & (F.col("maxx") >= minx) & (F.col("miny") <= maxy) & (F.col("maxy") >= miny)


def in_buffer(dx: Column, dy: Column, radius) -> Column:
    """Inside the outline of 64 segments that stands for a disc."""
    d = 2 * math.pi / SEGMENTS
    return F.hypot(dx, dy) * F.cos(F.pmod(F.atan2(dy, dx), F.lit(d)) - d / 2) <= _c(radius) * math.cos(d / 2)


def in_disc(dx: Column, dy: Column, radius) -> Column:
    return F.hypot(dx, dy) <= _c(radius)


def haversine_metres(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = (F.radians(_c(v)) for v in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def lens_area(distance: Column, radius: float) -> Column:
    """Common area of two discs of one radius."""
    r, half = float(radius), F.least(distance / (2 * float(radius)), F.lit(1.0))
    area = 2 * r * r * F.acos(half) - distance / 2 * F.sqrt(F.greatest(F.lit(4 * r * r) - distance * distance, F.lit(0.0)))
    return F.when(distance < 2 * r, area).otherwise(0.0)


def box_overlap_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"]))
    h = F.greatest(F.lit(0.0), F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"]))
    return w * h


def to_mercator(lon, lat) -> Column:
    """EPSG:4326 to EPSG:3857."""
    return point(F.radians(_c(lon)) * EARTH_RADIUS, F.log(F.tan(math.pi / 4 + F.radians(_c(lat)) / 2)) * EARTH_RADIUS)


def from_mercator(x, y) -> Column:
    """EPSG:3857 to EPSG:4326."""
    return point(F.degrees(_c(x) / EARTH_RADIUS), F.degrees(2 * F.atan(F.exp(_c(y) / EARTH_RADIUS)) - math.pi / 2))


def to_utm33(lon, lat) -> Column:
    """EPSG:4326 to EPSG:32633 by the series for the transverse Mercator projection (WGS 84, central meridian 15 E)."""
    a, f, k0 = 6_378_137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon) - 15.0)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, w = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), F.cos(phi) * lam
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - 35 * e2**3 / 3072 * F.sin(6 * phi))
    x = k0 * n * (w + (1 - t + c) * F.pow(w, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(w, 5) / 120) + 500_000
    y = k0 * (m + n * F.tan(phi) * (w * w / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(w, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(w, 6) / 720))
    return point(x, y)
