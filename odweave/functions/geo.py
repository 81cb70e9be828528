"""Planar geometry on points (x, y columns) and lines (arrays of structs), as Column expressions; hulls and overlays as plain functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[float, float]
#: Sides of rings that are tested one by one in an expression.
WRITTEN_OUT = 12


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """G3; by products, so that other engines give the same bits."""
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def rounded(x: Column) -> Column:
    """Half-even rounding to a whole number."""
    return F.bround(x, 0).cast("int")


def fraction_on(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where on a segment (0 to 1) the place nearest to a point is."""
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / n)))


def closest(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The place on a segment nearest to a point."""
    t = fraction_on(x, y, x1, y1, x2, y2)
    return x1 + t * (x2 - x1), y1 + t * (y2 - y1)


def line_length(line: Column) -> Column:
    """Length of an array of points."""
    a, b = F.slice(line, 1, F.greatest(F.lit(0), F.size(line) - 1)), F.slice(line, 2, F.greatest(F.lit(0), F.size(line) - 1))
    return F.aggregate(F.zip_with(a, b, lambda p, q: distance(p["x"], p["y"], q["x"], q["y"])), F.lit(0.0), lambda s, d: s + d)


def flow_angle(ox: Column, oy: Column, dx: Column, dy: Column) -> Column:
    """Direction of a flow in degrees, 0 to under 360."""
    a = F.degrees(F.atan2(dy - oy, dx - ox))
    return F.when(a < 0, a + 360).otherwise(a)


def line_angle_similarity(a: Column, b: Column) -> Column:
    """1 for lines of the same direction (either way), 0 for perpendicular ones, from their angles in degrees."""
    d = F.abs(a - b) % 180
    return (90 - F.when(d > 90, 180 - d).otherwise(d)) / 90


def inside_convex(x: Column, y: Column, ring: list[Point], boundary: bool) -> Column:
    """Whether a point is in a convex ring (counter-clockwise); boundary: points on its edge count."""
    sides = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True)]
    tests = [s >= 0 if boundary else s > 0 for s in sides]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _next(ring: Column, i: Column) -> Column:
    """The point after place i (from 0) of a ring that may or may not repeat its first point."""
    return F.get(ring, (i + 1) % F.size(ring))


def inside_ring(x: Column, y: Column, ring: Column, most: int | None = None) -> Column:
    """Whether a point is inside any simple ring (array of points, either direction, convex or not), by counting the sides a ray crosses. most: no ring has more points; small numbers are written out, which is much faster."""

    def crossed(a: Column, i: Column) -> Column:
        b = _next(ring, i)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    if most is not None and most <= WRITTEN_OUT:
        one = lambda i: F.when(crossed(F.get(ring, F.lit(i)), F.lit(i)), F.lit(1)).otherwise(F.lit(0))
        hits = sum((one(i) for i in range(most)), F.lit(0))
        return F.when(ring.isNotNull(), hits % 2 == 1)
    return F.size(F.filter(F.transform(ring, crossed), lambda h: F.coalesce(h, F.lit(False)))) % 2 == 1


def ring_area(ring: Column) -> Column:
    """The area of any simple ring."""
    return F.abs(F.aggregate(F.transform(ring, lambda a, i: a["x"] * _next(ring, i)["y"] - _next(ring, i)["x"] * a["y"]), F.lit(0.0), lambda s, c: s + c)) / 2


def start_point(line: Column) -> Column:
    """First point of a line; null for an empty one."""
    return F.get(line, F.lit(0))


def end_point(line: Column) -> Column:
    """Last point of a line; null for an empty one."""
    return F.get(line, F.size(line) - 1)


def extent(line: Column) -> Column:
    """struct(x_min, y_min, x_max, y_max) of a line or ring."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x_min"), F.array_min(ys).alias("y_min"), F.array_max(xs).alias("x_max"), F.array_max(ys).alias("y_max"))


def nearest_on_line(x: Column, y: Column, line: Column) -> Column:
    """struct(dist, along, x, y) of the place on a line of any number of points nearest to a point; of equal places the first."""

    def one(a: Column, i: Column) -> Column:
        b = F.get(line, i + 1)
        t = fraction_on(x, y, a["x"], a["y"], b["x"], b["y"])
        px, py = a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"])
        return F.struct(distance(x, y, px, py).alias("dist"), (line_length(F.slice(line, F.lit(1), i + 1)) + distance(a["x"], a["y"], px, py)).alias("along"), px.alias("x"), py.alias("y"))

    return F.array_min(F.transform(F.slice(line, F.lit(1), F.size(line) - 1), one))


def ellipse(cx: Column, cy: Column, a: Column, b: Column, turn: Column, n: int = 32) -> Column:
    """Ring of n points of an ellipse with half axes a and b, turned by an angle in radians."""
    t = F.array(*[F.lit(6.283185307179586 * i / n) for i in range(n)])
    return F.transform(t, lambda s: F.struct((cx + a * F.cos(s) * F.cos(turn) - b * F.sin(s) * F.sin(turn)).alias("x"), (cy + a * F.cos(s) * F.sin(turn) + b * F.sin(s) * F.cos(turn)).alias("y")))


def utm(lat: Column, lng: Column, zone: int = 32) -> tuple[Column, Column]:
    """G1: geographic WGS 84 to UTM (north) easting and northing, by Krueger's series to the fourth order."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4)
    k = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lng - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e, m = eta, xi
    for j, c in enumerate(alpha, 1):
        e = e + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        m = m + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * a * e, 0.9996 * a * m


def convex_hull(points: list[Point]) -> list[Point]:
    """Counter-clockwise ring without repeated or collinear points; fewer than three are returned as they are."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq: list[Point]) -> list[Point]:
        out: list[Point] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def area(ring: list[Point]) -> float:
    """Shoelace area; 0 for fewer than three points."""
    return abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]], strict=True))) / 2 if len(ring) > 2 else 0.0


def centroid(ring: list[Point]) -> Point:
    """Of a ring with an area; otherwise the mean of its points."""
    cross = [(ax * by - bx * ay, ax + bx, ay + by) for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]], strict=True)]
    a = sum(c for c, _, _ in cross)
    if abs(a) < 1e-12:
        return sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring)
    return sum(c * x for c, x, _ in cross) / (3 * a), sum(c * y for c, _, y in cross) / (3 * a)


def convex_overlap(a: list[Point], b: list[Point]) -> float:
    """Area that two convex rings share, by cutting one with each side of the other."""
    if len(a) < 3 or len(b) < 3:
        return 0.0
    ring = list(a)
    for (ax, ay), (bx, by) in zip(b, [*b[1:], b[0]], strict=True):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in ring]
        cut: list[Point] = []
        for i, p in enumerate(ring):
            q, s, t = ring[i - 1], side[i], side[i - 1]
            if (s >= 0) != (t >= 0):
                r = t / (t - s)
                cut.append((q[0] + r * (p[0] - q[0]), q[1] + r * (p[1] - q[1])))
            if s >= 0:
                cut.append(p)
        ring = cut
        if not ring:
            return 0.0
    return area(ring)
