"""Boolean operations on polygons: rings may be concave, have holes, touch and share edges; results may have several parts.

A polygon is an array of rings, the exterior first. The edges of both are split where they meet; a piece of an edge then lies
wholly inside, outside or on the boundary of the other polygon. The pieces that bound the result are kept, turned so that it
lies to their left, and stitched at each vertex to the next piece clockwise, which walks round one face at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from kerbside.functions import geo

from .geometry import POINTS_TYPE, _rows, _xy

#: Points nearer than this share of the extent are one.
SNAP = 1e-9


def area(ring: np.ndarray) -> float:
    """Signed: positive for a counter-clockwise ring."""
    x, y = (ring - ring[0]).T
    return float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


class _Points:
    """Numbered points; one within `eps` of a known point is that point."""

    def __init__(self, eps: float) -> None:
        self.eps, self.xy, self.cells = eps, [], {}

    def number(self, p) -> int:
        cx, cy = (math.floor(v / self.eps) for v in p)
        for i in (cx - 1, cx, cx + 1):
            for j in (cy - 1, cy, cy + 1):
                k = self.cells.get((i, j))
                if k is not None and math.dist(self.xy[k], p) <= self.eps:
                    return k
        self.cells[cx, cy] = len(self.xy)
        self.xy.append((float(p[0]), float(p[1])))
        return len(self.xy) - 1


def _turned(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Without repeated points; the exterior counter-clockwise, holes clockwise."""
    out = []
    for k, ring in enumerate(rings):
        ring = ring[np.any(ring != np.roll(ring, 1, axis=0), axis=1)] if len(ring) > 1 else ring
        if len(ring) > 2 and area(ring):
            out.append(ring if (area(ring) > 0) == (k == 0) else ring[::-1])
        elif k == 0:
            return []
    return out


def _edges(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rings), np.concatenate([np.roll(r, -1, axis=0) for r in rings])


def _pieces(a: tuple, b: tuple, points: _Points) -> tuple[set, set]:
    """The edges of both, split where they meet, as pairs of numbers; edges that run back and forth cancel."""
    (p, q), (r, s) = a, b
    d, e = q - p, s - r
    cross = d[:, None, 0] * e[None, :, 1] - d[:, None, 1] * e[None, :, 0]
    w = r[None, :, :] - p[:, None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[..., 0] * e[None, :, 1] - w[..., 1] * e[None, :, 0]) / cross
        u = (w[..., 0] * d[:, None, 1] - w[..., 1] * d[:, None, 0]) / cross
    splits = ([[] for _ in p], [[] for _ in r])
    for i, j in zip(*np.nonzero((t > 0) & (t < 1) & (u > 0) & (u < 1)), strict=True):
        k = points.number(p[i] + t[i, j] * d[i])
        splits[0][i].append(k)
        splits[1][j].append(k)
    for own, (begin, step), corners in ((splits[0], (p, d), r), (splits[1], (r, e), p)):  # corners of one that lie on edges of the other
        v = corners[None, :, :] - begin[:, None, :]
        along = (v * step[:, None, :]).sum(axis=2) / (step * step).sum(axis=1)[:, None]
        off = v - along[..., None] * step[:, None, :]
        for i, j in zip(*np.nonzero((along > 0) & (along < 1) & (np.hypot(off[..., 0], off[..., 1]) <= points.eps)), strict=True):
            own[i].append(points.number(corners[j]))
    out = []
    for own, (begin, end) in zip(splits, (a, b), strict=True):
        pieces: set[tuple[int, int]] = set()
        for i in range(len(begin)):
            first, last = points.number(begin[i]), points.number(end[i])
            at = np.array(points.xy[first])
            inner = sorted(set(own[i]) - {first, last}, key=lambda k, at=at: math.dist(points.xy[k], at))
            for x, y in zip([first, *inner], [*inner, last], strict=True):
                if (y, x) in pieces:
                    pieces.remove((y, x))
                elif x != y:
                    pieces.add((x, y))
        out.append(pieces)
    return out[0], out[1]


def _inside(at: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    (x0, y0), (x1, y1) = edges[0].T, edges[1].T
    px, py = at[:, 0, None], at[:, 1, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return ((((y0 > py) != (y1 > py)) & (px < (x1 - x0) * (py - y0) / (y1 - y0) + x0)).sum(axis=1) % 2).astype(bool)


def _stitched(pieces: list[tuple[int, int]], xy: np.ndarray) -> list[np.ndarray] | None:
    """Closed rings of all pieces; None if some don't close."""
    ahead: dict[int, list[int]] = {}
    for x, y in pieces:
        ahead.setdefault(x, []).append(y)
    rings = []
    while ahead:
        start = next(iter(ahead))
        ring, before, at = [start], None, start
        while True:
            choice = ahead.get(at)
            if not choice:
                return None
            if before is None or len(choice) == 1:
                k = 0
            else:
                back = math.atan2(*(xy[before] - xy[at])[::-1])
                k = min(range(len(choice)), key=lambda i, at=at, back=back, choice=choice: (back - math.atan2(*(xy[choice[i]] - xy[at])[::-1])) % (2 * math.pi) or 2 * math.pi)
            to = choice.pop(k)
            if not choice:
                del ahead[at]
            before, at = at, to
            if at in ring:  # a loop is closed, which may hang on what was walked before
                low = ring.index(at)
                rings.append(np.array(ring[low:]))
                ring = ring[: low + 1]
                before = ring[-2] if len(ring) > 1 else None
                if low == 0:
                    break
            else:
                ring.append(at)
    return [xy[r] for r in rings]


def combine(subject: list[np.ndarray], clip: list[np.ndarray], minus: bool) -> list[list[np.ndarray]]:
    """The parts of subject inside clip, or outside (minus), each an exterior and its holes. A subject whose pieces don't close
    (it crosses itself) is kept whole."""
    a, b = _turned(subject), _turned(clip)
    if not a or not b:
        return [a] if a and minus else []
    ea, eb = _edges(a), _edges(b)
    points = _Points(SNAP * max(1e-300, float(np.ptp(np.concatenate([ea[0], eb[0]]), axis=0).max())))
    pa, pb = _pieces(ea, eb, points)
    xy = np.array(points.xy)
    split = lambda own: (xy[[x for x, _ in own]], xy[[y for _, y in own]])
    within = lambda own, other: _inside((xy[[x for x, _ in own]] + xy[[y for _, y in own]]) / 2, split(other)) if own and other else np.zeros(len(own), bool)
    la, lb = sorted(pa), sorted(pb)
    shared = {(x, y) for x, y in la if (x, y) in pb}
    opposed = {(x, y) for x, y in la if (y, x) in pb}
    kept = [e for e, inside in zip(la, within(la, lb), strict=True) if e not in shared and e not in opposed and inside != minus]
    kept += [((y, x) if minus else (x, y)) for (x, y), inside in zip(lb, within(lb, la), strict=True) if inside and (x, y) not in shared and (y, x) not in opposed]
    kept += sorted(opposed if minus else shared)
    rings = _stitched(kept, xy)
    if rings is None:
        return [a]
    least = points.eps * math.sqrt(max(abs(area(r)) for r in rings)) if rings else 0
    outer = sorted((r for r in rings if area(r) > least), key=area)
    parts = [[r] for r in outer]
    for hole in (r for r in rings if area(r) < -least):
        middle = ((hole[0] + hole[1]) / 2)[None, :]
        for part in parts:  # the smallest exterior that holds it
            if _inside(middle, (part[0], np.roll(part[0], -1, axis=0)))[0]:
                part.append(hole)
                break
    return parts


_PARTS = ArrayType(ArrayType(POINTS_TYPE))
_ARROW = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def _operation(minus: bool):
    def run(subject: pa.Array, clip: pa.Array) -> pa.Array:
        out = []
        for s, c in zip(subject.to_pylist(), clip.to_pylist(), strict=True):
            parts = None if s is None or c is None else combine([_xy(r) for r in s], [_xy(r) for r in c], minus)
            out.append(None if parts is None else [[_rows(r) for r in part] for part in parts])
        return pa.array(out, _ARROW)

    return F.arrow_udf(run, _PARTS)


#: (subject, clip) -> parts: what of the subject lies inside, or outside, of the clip; null where either is.
intersection, difference = _operation(False), _operation(True)


def parts_area(parts: Column | str) -> Column:
    """The area of all parts without their holes."""
    rings = lambda part: F.aggregate(F.transform(part, lambda r, i: F.when(i == 0, geo.ring_area(r)).otherwise(-geo.ring_area(r))), F.lit(0.0), lambda a, v: a + v)
    return F.aggregate(F.transform(parts, rings), F.lit(0.0), lambda a, v: a + v)
