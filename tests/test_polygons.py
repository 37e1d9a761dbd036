"""Polygon intersection and difference: areas add up, points agree, and hand-made cases."""

from __future__ import annotations

import numpy as np
import pytest

from kerbside.operators import polygons
from kerbside.operators.geometry import inside


def box(x0, y0, x1, y1):
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)


def star(rng, x, y, n, low, high):
    at = np.sort(rng.uniform(0, 2 * np.pi, n)) if n > 12 else np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = rng.uniform(low, high, n)
    return np.stack([x + r * np.cos(at), y + r * np.sin(at)], axis=1)


def size(parts):
    return sum(abs(polygons.area(part[0])) - sum(abs(polygons.area(h)) for h in part[1:]) for part in parts)


def holds(rings, p):
    return inside(p, rings[0]) and not any(inside(p, h) for h in rings[1:])


@pytest.mark.parametrize("seed", range(40))
def test_areas_add_up(seed):
    rng = np.random.default_rng(seed)
    a = [star(rng, 0, 0, int(rng.integers(5, 40)), 4, 10)] + ([star(rng, 0, 0, 9, 0.5, 2)[::-1]] if seed % 2 else [])
    b = [star(rng, rng.uniform(-6, 6), rng.uniform(-6, 6), int(rng.integers(5, 40)), 3, 9)]
    if seed % 3 == 0:
        b.append(star(rng, *b[0].mean(axis=0), 7, 0.3, 0.6))
    if seed % 4 == 0:  # on a coarse grid corners meet corners and edges
        a, b = [[np.round(r) for r in x] for x in (a[:1], b[:1])]
        a, b = ([box(-5, -5, 5, 5)], b) if seed % 8 else ([box(-5, -3, 5, 5)], [box(int(rng.integers(-5, 3)), -3, 5, int(rng.integers(0, 6)))])
    both, left, right = polygons.combine(a, b, False), polygons.combine(a, b, True), polygons.combine(b, a, True)
    assert size(both) + size(left) == pytest.approx(size([a]), rel=1e-9)
    assert size(both) + size(right) == pytest.approx(size([b]), rel=1e-9)
    assert size(both) == pytest.approx(size(polygons.combine(b, a, False)), rel=1e-9)
    for p in rng.uniform(-12, 12, (300, 2)):
        assert any(holds(x, p) for x in both) == (holds(a, p) and holds(b, p))
        assert any(holds(x, p) for x in left) == (holds(a, p) and not holds(b, p))


def test_hand_made():
    u = np.array([(0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9)], float)
    two = polygons.combine([box(-1, 5, 10, 7)], [u], False)
    assert sorted(size([p]) for p in two) == [6, 6] and all(len(p) == 1 for p in two)
    ring = polygons.combine([box(0, 0, 9, 9)], [box(3, 3, 6, 6)], True)
    assert [len(p) for p in ring] == [2] and size(ring) == 72
    assert size(polygons.combine([box(4, 4, 5, 5)], [box(0, 0, 9, 9), box(3, 3, 6, 6)], False)) == 0
    assert size(polygons.combine([box(2, 2, 7, 7)], [box(0, 0, 9, 9), box(3, 3, 6, 6)], False)) == 16
    assert size(polygons.combine([u], [u], False)) == 63 and polygons.combine([u], [u], True) == []
    assert polygons.combine([u], [box(20, 20, 30, 30)], False) == [] and size(polygons.combine([u], [box(20, 20, 30, 30)], True)) == 63
    assert size(polygons.combine([box(0, 0, 4, 4)], [box(4, 0, 8, 4)], False)) == 0 and size(polygons.combine([box(0, 0, 4, 4)], [box(4, 0, 8, 4)], True)) == 16
    assert size(polygons.combine([box(0, 0, 4, 4)], [box(4, 4, 8, 8)], True)) == 16  # corners touch
    assert size(polygons.combine([u[::-1]], [box(0, 0, 9, 3)], False)) == 27
    assert polygons.combine([np.zeros((0, 2))], [u], False) == [] and polygons.combine([u], [np.zeros((2, 2))], False) == []


def test_columns(spark):
    points = lambda r: [(float(x), float(y)) for x, y in r]
    ring = "array<array<struct<x:double,y:double>>>"
    rows = [(1, [points(box(0, 0, 9, 9))], [points(box(3, 3, 6, 6))]), (2, None, [points(box(0, 0, 1, 1))])]
    df = spark.createDataFrame(rows, f"id long, s {ring}, c {ring}").withColumn("out", polygons.difference("s", "c")).withColumn("both", polygons.intersection("s", "c"))
    got = {r.id: (r.out, r.a, r.b) for r in df.select("id", "out", polygons.parts_area("out").alias("a"), polygons.parts_area("both").alias("b")).collect()}
    assert got[1][1:] == (72.0, 9.0) and [len(p) for p in got[1][0]] == [2] and got[2] == (None, None, None)
