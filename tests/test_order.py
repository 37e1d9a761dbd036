"""Exact selection against sorting, in few passes, and a plan without a window over the table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators import order
from kerbside.plans import aggregates, catalog


@pytest.mark.parametrize("kind", ["ties", "wide", "long"])
def test_ranks(spark, monkeypatch, kind):
    monkeypatch.setattr(order, "FEW", 20)
    monkeypatch.setattr(order, "BUCKETS", 16)
    rng = random.Random(kind)
    make = {"ties": lambda: float(rng.randrange(3) if rng.random() < 0.8 else rng.random()), "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), "long": lambda: rng.randrange(-(1 << 62), 1 << 62)}[kind]
    values = [make() for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], f"x {'long' if kind == 'long' else 'double'}").repartition(3)
    wanted = [0, 17, 500, 999, 1000, -1]
    got, n, low, high = order.at_ranks(df, "x", lambda n: wanted)
    values.sort()
    assert (n, low, high) == (1000, values[0], values[-1])
    assert got == [values[k] if 0 <= k < 1000 else None for k in wanted]


def test_no_rows(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert order.at_ranks(df, "x", lambda n: [0]) == ([None], 0, None, None)
    assert aggregates.upper_median(df, "x") == 1.0
    assert tuple(aggregates.index_range(df, "x").first()) == (None, None)


def test_passes_grow_slowly(spark, monkeypatch):
    passes = []
    plain = order._parts
    monkeypatch.setattr(order, "_parts", lambda *a: passes.append(1) or plain(*a))
    df = spark.range(1_000_000).select((F.xxhash64("id") % 1_000_003).cast("double").alias("x"))
    got, *_ = order.at_ranks(df, "x", lambda n: [n // 2])
    assert len(passes) <= 3
    below, upto = df.agg(F.sum((F.col("x") < got[0]).cast("long")), F.sum((F.col("x") <= got[0]).cast("long"))).first()
    assert below <= 500_000 < upto


@pytest.mark.parametrize("name", ["agg_index_percentile", "agg_floor_percentile"])
def test_no_window_over_the_table(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Window" not in plan
