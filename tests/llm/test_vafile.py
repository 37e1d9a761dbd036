"""Exact top-k against all scores, and on odd tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from kerbside.llm import common, vafile

VECTORS = "vec_id long, embedding array<float>, label int"


def expected(rows, k, every):
    """query_id, rank, vec_id, score by all pairs, on vectors padded with zeros."""
    known = []
    for i, v, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            known.append((i, [max(-(1 << 31), min((1 << 31) - 1, math.floor(256 * float(np.float32(x))))) for x in v]))
    out = []
    for a, (i, q) in enumerate(known):
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v, strict=False)), j is None, j or 0, b) for b, (j, v) in enumerate(known) if b != a]
        for place, (score, missing, j, _) in enumerate(sorted(scored)[:k], 1):
            out.append((i, place, None if missing else j, max(-(1 << 63), min((1 << 63) - 1, -score))))
    return sorted(out, key=repr)


def made(seed, n, dims, spread):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) for _ in range(dims)], 0) for i in range(n)]
    hot = rows[3][1]
    rows += [(n + i, hot, 1) for i in range(n // 2)]
    rows += [(0, rows[7][1], 2), (0, rows[7][1], 2), (10, hot, 2), (None, hot, 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "dims", "spread", "block", "k"), [(1, 8, 0.1, 7, 5), (2, 3, 0.004, 64, 3), (3, 16, 0.3, 8192, 5), (4, 4, 1e5, 16, 1)])
def test_top_k(spark, monkeypatch, seed, dims, spread, block, k):
    monkeypatch.setattr(vafile, "STRIPE", 3)
    common.prepare(spark)
    rows = made(seed, 120, dims, spread)
    got = vafile.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), k=k, every=10, data_block=block, query_block=5).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows, k, 10)


def test_odd_vectors(spark):
    common.prepare(spark)
    big = 3e38
    rows = [
        (0, [1.0, 2.0], 0), (10, [1.0], 0), (20, [], 0), (30, None, 0), (40, [1.0, None], 0), (50, [math.nan, 1.0], 0), (60, [math.inf, 1.0], 0),
        (70, [big, big, big], 0), (3, [-big, big], 0), (4, [-1.0, -1.0, -1.0, -1.0], 0), (None, [1.0, 1.0], 0), (-10, [0.5, 0.25], 0), (5, [1.0, 2.0], 0),
    ]
    got = vafile.top_k(spark.createDataFrame(rows, VECTORS).withColumnRenamed("label", "entry"), every=10).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows, 5, 10)


def test_no_vectors_and_no_queries(spark):
    common.prepare(spark)
    df = spark.createDataFrame([(0, [1.0], 0)], VECTORS)
    assert vafile.top_k(df.limit(0)).count() == 0
    assert vafile.top_k(df).count() == 0  # no row but the query's own
    assert vafile.top_k(spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], VECTORS)).count() == 0
    assert vafile.top_k(spark.createDataFrame([(0, None, 0)], VECTORS)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    v = rng.integers(-300, 300, (500, 6))
    cells = vafile.Cells(v[:50], v.min(axis=0), v.max(axis=0), cells=8)
    low, high = cells.ends(cells.codes(v))
    assert (low.T <= v).all() and (v <= high.T).all()


def test_rounds_go_on_until_the_result_is_certain(spark, monkeypatch):
    """With one cell a dimension the bounds say nothing, so every vector is visited, in rounds."""
    monkeypatch.setattr(vafile, "FIRST", 1)
    plain = vafile.Cells.__init__
    monkeypatch.setattr(vafile.Cells, "__init__", lambda self, sample, least, largest, cells=256: plain(self, sample, least, largest, 2))
    common.prepare(spark)
    rows = made(9, 90, 5, 0.2)
    got = vafile.top_k(spark.createDataFrame(rows, VECTORS), k=2, every=30).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows, 2, 30)
