"""Geometry as Column expressions over double columns; all of it stays in generated code.

Points are two columns, in metres east and north. Rings and polylines are ARRAY<STRUCT<x, y>>.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius, and the origin of the city's projection.
EARTH_RADIUS_M = 6371008.8
ORIGIN_LAT, ORIGIN_LON = 40.7831, -73.9712
EPS = 1e-9


def col(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))


def enu_x(lon, lat0: float = ORIGIN_LAT, lon0: float = ORIGIN_LON) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.radians(col(lon) - lon0) * F.lit(math.cos(math.radians(lat0)))


def enu_y(lat, lat0: float = ORIGIN_LAT) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.radians(col(lat) - lat0)


def enu_lon(x, lat0: float = ORIGIN_LAT, lon0: float = ORIGIN_LON) -> Column:
    return F.lit(lon0) + F.degrees(col(x) / F.lit(EARTH_RADIUS_M * math.cos(math.radians(lat0))))


def enu_lat(y, lat0: float = ORIGIN_LAT) -> Column:
    return F.lit(lat0) + F.degrees(col(y) / F.lit(EARTH_RADIUS_M))


def stateplane_to_wgs84(easting_ft, northing_ft) -> tuple[Column, Column]:
    """(lat, lon) of New York Long Island state plane feet: inverse Lambert conformal conic, eight fixed iterations."""
    a, f = 6378137.0, 1 / 298.257222101
    e = math.sqrt(2 * f - f * f)
    to_m = 0.3048006096
    p1, p2, p0, l0 = (math.radians(v) for v in (40 + 40 / 60, 41 + 2 / 60, 40 + 10 / 60, -74.0))
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big_f = m(p1) / (n * t(p1) ** n)
    rho0 = a * big_f * t(p0) ** n
    x, y = col(easting_ft) * to_m - 300000.0, F.lit(rho0) - col(northing_ft) * to_m
    ts = F.pow(F.sqrt(x * x + y * y) / (a * big_f), F.lit(1 / n))
    lat = math.pi / 2 - 2 * F.atan(ts)
    for _ in range(8):
        s = F.sin(lat) * e
        lat = math.pi / 2 - 2 * F.atan(ts * F.pow(2 / (1 + s) - 1, F.lit(e / 2)))  # names s once: the tree stays small
    return F.degrees(lat), F.degrees(F.atan2(x, y) / n + l0)


def dot(ax, ay, bx, by) -> Column:
    return col(ax) * col(bx) + col(ay) * col(by)


def cross(ax, ay, bx, by) -> Column:
    return col(ax) * col(by) - col(ay) * col(bx)


def length(x, y) -> Column:
    return F.sqrt(col(x) * col(x) + col(y) * col(y))


def distance2(ax, ay, bx, by) -> Column:
    dx, dy = col(ax) - col(bx), col(ay) - col(by)
    return dx * dx + dy * dy


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt(distance2(ax, ay, bx, by))


def lerp(a, b, t) -> Column:
    return col(a) + (col(b) - col(a)) * col(t)


def normalized(x, y) -> tuple[Column, Column]:
    """A unit vector; +x for one shorter than EPS."""
    n = length(x, y)
    return F.when(n < EPS, 1.0).otherwise(col(x) / n), F.when(n < EPS, 0.0).otherwise(col(y) / n)


def bearing(dx, dy) -> Column:
    """Radians clockwise from north."""
    return F.atan2(col(dx), col(dy))


def angle_diff(a, b) -> Column:
    """The angle between two headings, in [0, pi]; the remainder is truncated."""
    d = F.abs(col(a) - col(b)) % F.lit(2 * math.pi)
    return F.when(d > math.pi, 2 * math.pi - d).otherwise(d)


def clamp(v, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(v)))


def along(px, py, ax, ay, bx, by) -> Column:
    """Where on the segment a-b, 0 to 1, the point nearest to p lies; 0 on a segment without length."""
    dx, dy = col(bx) - col(ax), col(by) - col(ay)
    n = dx * dx + dy * dy
    return F.when(n < EPS * EPS, 0.0).otherwise(clamp(((col(px) - col(ax)) * dx + (col(py) - col(ay)) * dy) / n, 0.0, 1.0))


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    t = along(px, py, ax, ay, bx, by)
    return distance(px, py, lerp(ax, bx, t), lerp(ay, by, t))


def perp_line_distance(px, py, ax, ay, bx, by) -> Column:
    """To the infinite line through a and b; to a if they coincide."""
    dx, dy = col(bx) - col(ax), col(by) - col(ay)
    n = F.sqrt(dx * dx + dy * dy)
    return F.when(n < EPS, distance(px, py, ax, ay)).otherwise(F.abs(dx * (col(ay) - col(py)) - dy * (col(ax) - col(px))) / n)


def half_fov(heading_deg, full_fov_deg) -> Column:
    """Half the field of view in radians; pi (all around) without a heading."""
    return F.when(col(heading_deg).isNull(), math.pi).otherwise(F.radians(col(full_fov_deg)) / 2)


def covers(px, py, ax, ay, heading_rad, half_fov_rad, range_m) -> Column:
    """Whether a wedge at a covers p: within range, and within the field of view or omnidirectional; its apex always."""
    dx, dy = col(px) - col(ax), col(py) - col(ay)
    d2 = dx * dx + dy * dy
    seen = (col(half_fov_rad) >= math.pi) | (angle_diff(bearing(dx, dy), F.coalesce(col(heading_rad), F.lit(0.0))) <= col(half_fov_rad))
    return (d2 <= col(range_m) * col(range_m)) & ((d2 < EPS * EPS) | seen)


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether a-b and c-d cross strictly: touching and collinear ones don't."""
    side = lambda px, py, qx, qy, rx, ry: cross(col(qx) - col(px), col(qy) - col(py), col(rx) - col(px), col(ry) - col(py))
    return (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)


def _edges(ring: Column, zero: Column, add) -> Column:
    """Folds add(acc, x0, y0, x1, y1) over a ring's edges, the closing one first."""
    n = F.size(ring)
    at = lambda i, f: ring[i].getField(f)

    def step(acc: Column, i: Column) -> Column:
        j = F.when(i == 0, n - 1).otherwise(i - 1)
        return add(acc, at(j, "x"), at(j, "y"), at(i, "x"), at(i, "y"))

    return F.aggregate(F.sequence(F.lit(0), n - 1), zero, step)


def point_in_ring(px, py, ring) -> Column:
    """Even-odd ray cast with half-open edges; false for fewer than three points."""
    x, y, ring = col(px), col(py), col(ring)

    def hit(acc, x0, y0, x1, y1):
        straddles = (y0 > y) != (y1 > y)
        return acc + F.when(straddles & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0), 1).otherwise(0)

    return F.when(F.size(ring) < 3, False).otherwise(_edges(ring, F.lit(0), hit) % 2 == 1)


def ring_area2(ring) -> Column:
    """Twice the signed area."""
    return F.when(F.size(col(ring)) < 3, 0.0).otherwise(_edges(col(ring), F.lit(0.0), lambda a, x0, y0, x1, y1: a + x0 * y1 - x1 * y0))


def ring_area(ring) -> Column:
    return F.abs(ring_area2(ring)) / 2


def vertex_mean(ring) -> tuple[Column, Column]:
    ring = col(ring)
    total = lambda f: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p.getField(f))
    return total("x") / F.size(ring), total("y") / F.size(ring)


def ring_centroid(ring) -> tuple[Column, Column]:
    """Area-weighted; the mean vertex where the area is below EPS."""
    ring = col(ring)
    a2 = ring_area2(ring)
    mx, my = vertex_mean(ring)
    cx = _edges(ring, F.lit(0.0), lambda a, x0, y0, x1, y1: a + (x0 + x1) * (x0 * y1 - x1 * y0)) / (3 * a2)
    cy = _edges(ring, F.lit(0.0), lambda a, x0, y0, x1, y1: a + (y0 + y1) * (x0 * y1 - x1 * y0)) / (3 * a2)
    flat = F.abs(a2) / 2 < EPS
    return F.when(flat, mx).otherwise(cx), F.when(flat, my).otherwise(cy)


def ring_bbox(ring) -> tuple[Column, Column, Column, Column]:
    """minx, miny, maxx, maxy."""
    xs, ys = F.transform(col(ring), lambda p: p.getField("x")), F.transform(col(ring), lambda p: p.getField("y"))
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def in_bbox(px, py, minx, miny, maxx, maxy) -> Column:
    return col(px).between(col(minx), col(maxx)) & col(py).between(col(miny), col(maxy))
