"""Rewrites between rows and arrays of points."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from kerbside.functions import geo

POINTS = "array<struct<x:double,y:double>>"
POINTS_TYPE = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


def rings(points: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, ring, minx, miny, maxx, maxy) from ordered corner rows."""
    out = points.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(seq, "x", "y"))), lambda p: F.struct(p.x, p.y)).alias("ring"))
    return out.withColumns(dict(zip(("minx", "miny", "maxx", "maxy"), geo.ring_bbox("ring"), strict=True)))


def densified(lines: DataFrame, step: float) -> DataFrame:
    """Points at most `step` apart along each segment (x0, y0, x1, y1), ends included: columns i, x, y."""
    n = F.greatest(F.lit(1), F.ceil(geo.distance("x0", "y0", "x1", "y1") / step)).cast("int")
    out = lines.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    t = F.col("i") / F.col("n")
    return out.withColumns({"i": F.col("i").cast("long"), "x": geo.lerp("x0", "x1", t), "y": geo.lerp("y0", "y1", t)}).drop("n")


def rasterized(lines: DataFrame, key: str, cell: float) -> DataFrame:
    """The distinct cells that a segment visits, stepping 0.6 of a cell."""
    steps = densified(lines, 0.6 * cell)
    return steps.select(key, F.floor(F.col("x") / cell).cast("long").alias("cx"), F.floor(F.col("y") / cell).cast("long").alias("cy")).distinct()


def quantized(points: Column) -> tuple[Column, Column, Column]:
    """First point, and the differences between the rounded metre offsets of consecutive points."""
    grid = lambda f: F.transform(points, lambda p: F.round(p.getField(f) - points[0].getField(f)).cast("int"))
    delta = lambda g: F.transform(F.sequence(F.lit(0), F.size(points) - 1), lambda i: F.when(i == 0, g[0]).otherwise(g[i] - g[i - 1]))
    return points[0], delta(grid("x")), delta(grid("y"))


def dequantized(origin: Column, dx: Column, dy: Column) -> Column:
    """The points again, within half a metre."""
    total = lambda d, i: F.aggregate(F.slice(d, F.lit(1), i + 1), F.lit(0), lambda a, v: a + v)
    return F.transform(F.sequence(F.lit(0), F.size(dx) - 1), lambda i: F.struct((origin.getField("x") + total(dx, i)).alias("x"), (origin.getField("y") + total(dy, i)).alias("y")))


def _xy(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)


def _rows(xy: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def simplify(xy: np.ndarray, eps: float, to_line: bool) -> np.ndarray:
    """Keeps the ends and, between kept points, the farthest one while it is farther than eps: from the line through them
    (to_line), or from the segment."""
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    todo = [(0, len(xy) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, mid = xy[a], xy[b], xy[a + 1 : b]
        d = q - p
        n = float(d @ d)
        if n < 1e-18:
            far = np.hypot(*(mid - p).T)
        elif to_line:
            far = np.abs(d[0] * (p[1] - mid[:, 1]) - d[1] * (p[0] - mid[:, 0])) / math.sqrt(n)
        else:
            t = np.clip(((mid - p) @ d) / n, 0, 1)
            far = np.hypot(*(mid - p - t[:, None] * d).T)
        k = int(np.argmax(far))
        if far[k] > eps:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return xy[keep]


def rdp_simplify(eps: float):
    """Ramer-Douglas-Peucker by line distance."""

    @pandas_udf(POINTS_TYPE)
    def run(points: pd.Series) -> pd.Series:
        return points.map(lambda p: _rows(simplify(_xy(p), eps, True)) if p is not None and len(p) > 2 else p)

    return run


def dp_decimate(eps: float):
    """Douglas-Peucker by segment distance."""

    @pandas_udf(POINTS_TYPE)
    def run(points: pd.Series) -> pd.Series:
        return points.map(lambda p: _rows(simplify(_xy(p), eps, False)) if p is not None and len(p) > 2 else p)

    return run


def hull(xy: np.ndarray) -> np.ndarray | None:
    """Monotone chain, counter-clockwise; None for fewer than three distinct points."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return None

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def convex_hulls(points: DataFrame, key: str) -> DataFrame:
    """(key, hull) in two levels: hulls of salted parts, then of their corners, so no group meets whole in one task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy(float))
        corners = pdf[["x", "y"]].drop_duplicates().to_numpy(float) if h is None else h
        return pd.DataFrame({key: pdf[key].iloc[0], "x": corners[:, 0], "y": corners[:, 1]})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "hull": [None if h is None else _rows(h)]})

    kind = points.schema[key].dataType.simpleString()
    parts = points.select(key, "x", "y").withColumn("__salt", F.pmod(F.hash("x", "y"), F.lit(16)))
    return parts.groupBy(key, "__salt").applyInPandas(one, f"{key} {kind}, x double, y double").groupBy(key).applyInPandas(last, f"{key} {kind}, hull {POINTS}")


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Sutherland-Hodgman against a convex ring in counter-clockwise order."""
    out = subject
    for a, b in zip(clip, np.roll(clip, -1, axis=0), strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        new = []
        for i in range(len(out)):
            p, q, sp, sq = out[i - 1], out[i], side[i - 1], side[i]
            if (sp >= 0) != (sq >= 0):
                new.append(p + (q - p) * (sp / (sp - sq)))
            if sq >= 0:
                new.append(q)
        out = np.array(new).reshape(-1, 2)
    return out


@pandas_udf(POINTS_TYPE)
def clip_polygon(subject: pd.Series, clip: pd.Series) -> pd.Series:
    """The part of each subject ring inside a convex counter-clockwise clip ring; empty where they don't meet."""
    return pd.Series([None if s is None or c is None else _rows(clip_convex(_xy(s), _xy(c))) for s, c in zip(subject, clip, strict=True)])


def inside(p: np.ndarray, ring: np.ndarray) -> bool:
    x0, y0 = np.roll(ring, 1, axis=0).T
    x1, y1 = ring.T
    straddles = (y0 > p[1]) != (y1 > p[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        return bool((straddles & (p[0] < (x1 - x0) * (p[1] - y0) / (y1 - y0) + x0)).sum() % 2)


def clip_line(line: np.ndarray, ring: np.ndarray, steps: int = 24) -> list[np.ndarray]:
    """The runs of a polyline inside a ring; where it crosses, the point after `steps` bisections ends or begins a run."""
    runs: list[list[np.ndarray]] = []
    within = [inside(p, ring) for p in line]
    for i, p in enumerate(line):
        if i and within[i] != within[i - 1]:
            lo, hi = line[i - 1], p
            for _ in range(steps):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if inside(mid, ring) == within[i - 1] else (lo, mid)
            mid = (lo + hi) / 2
            if within[i]:
                runs.append([mid])
            else:
                runs[-1].append(mid)
        if within[i]:
            if not i or not runs:
                runs.append([])
            runs[-1].append(p)
    return [np.array(r) for r in runs if len(r) > 1]


@pandas_udf(ArrayType(POINTS_TYPE))
def clip_polyline(line: pd.Series, ring: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else [_rows(r) for r in clip_line(_xy(a), _xy(b))] for a, b in zip(line, ring, strict=True)])


def decimated(points: Column, least: float) -> Column:
    """Keeps the first and last point, and each farther than `least` from the last one kept."""
    n = F.size(points)
    start = F.struct(F.array(points[0]).alias("kept"), points[0].alias("last"))

    def step(acc: Column, i: Column) -> Column:
        p = points[i]
        far = geo.distance2(p.x, p.y, acc.last.x, acc.last.y) > least * least
        keep = far | (i == n - 1)
        return F.struct(F.when(keep, F.concat(acc.kept, F.array(p))).otherwise(acc.kept).alias("kept"), F.when(keep, p).otherwise(acc.last).alias("last"))

    return F.when(n < 2, points).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step, lambda acc: acc.kept))


def spread(ys: Column, gap: float) -> Column:
    """Rising ys, each pushed up to lie `gap` above the one before."""
    first = F.array(ys[0])
    step = lambda acc, i: F.concat(acc, F.array(F.greatest(ys[i], F.element_at(acc, -1) + gap)))
    return F.when(F.size(ys) < 2, ys).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ys) - 1, F.lit(1))), first, step))
