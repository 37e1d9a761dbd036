"""Exact order statistics of a whole table, without a window over it and without collecting it.

The distinct values and their counts are written once, in spark.checkpoint.dir; passes read these alone, so what computes the
rows runs once. The rows are counted in buckets between approximate quantiles of the values; of the bucket that holds the wanted
rank the rows are counted again, in buckets of its own, until all its values are equal or few rows are left, whose values are
counted one by one. Each pass divides the values that are left by about BUCKETS, so passes grow as their logarithm. To the
driver come bounds and counts of buckets, and FEW distinct values with their counts at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.operators.graph import checkpointed

BUCKETS, FEW = 64, 4096
#: Accuracy of the quantiles that bound buckets; the counts are exact whatever it is.
ACCURACY = 1000


@dataclass(frozen=True)
class Span:
    """Values from low to high, both included, of which `before` rows are less than low."""

    low: object
    high: object
    before: int
    rows: int


def _within(s: Span) -> Column:
    return (F.col("v") >= F.lit(s.low)) & (F.col("v") <= F.lit(s.high))


def _parts(values: DataFrame, spans: list[Span]) -> dict[Span, list[Span]]:
    """Each span cut at quantiles of its distinct values; the parts that have rows, in order."""
    probes = F.array(*(F.lit(k / BUCKETS) for k in range(1, BUCKETS)))
    some = values.where(reduce(Column.__or__, map(_within, spans)))
    bounds = some.agg(*(F.percentile_approx(F.when(_within(s), F.col("v")), probes, ACCURACY).alias(f"s{i}") for i, s in enumerate(spans))).first()
    bucket = F.lit(None).cast("struct<span:int,bucket:int>")
    for i, s in enumerate(spans):
        # a bound is a bucket by itself, so that every pass parts a span, whatever its ties
        above = reduce(Column.__add__, (side.cast("int") for b in sorted(set(bounds[i])) for side in (F.col("v") >= F.lit(b), F.col("v") > F.lit(b))))
        bucket = F.when(_within(s), F.struct(F.lit(i).alias("span"), above.alias("bucket"))).otherwise(bucket)
    counted = some.groupBy(bucket.alias("b")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("n")).collect()
    out = {}
    for i, s in enumerate(spans):
        before, parts = s.before, []
        for r in sorted((r for r in counted if r.b.span == i), key=lambda r: r.b.bucket):
            parts.append(Span(r.low, r.high, before, r.n))
            before += r.n
        out[s] = parts
    return out


def at_ranks(df: DataFrame, value: str, ranks: Callable[[int], list[int]]) -> tuple[list, int, object, object]:
    """The values at zero-based ranks of the sorted values, the number of these, the least and the largest. Nulls and NaN take no
    part. ranks gets the number; ranks outside of it give None."""
    rows = df.select(F.col(value).alias("v")).where("v IS NOT NULL")
    if df.schema[value].dataType.simpleString() in ("double", "float"):
        rows = rows.where(~F.isnan("v"))
    values = checkpointed(rows.groupBy("v").agg(F.count("*").alias("n")))
    n, low, high = values.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("v"), F.max("v")).first()
    wanted = ranks(n)
    held = {k: Span(low, high, 0, n) for k in wanted if 0 <= k < n}
    found: dict[int, object] = {}
    while True:
        for k, s in list(held.items()):
            if s.low == s.high:
                found[k] = s.low
                del held[k]
        if small := {s for s in held.values() if s.rows <= FEW}:
            few = values.where(reduce(Column.__or__, map(_within, small))).collect()
            for k, s in list(held.items()):
                if s in small:
                    upto = s.before
                    for v, count in sorted((r.v, r.n) for r in few if s.low <= r.v <= s.high):
                        upto += count
                        if upto > k:
                            found[k] = v
                            break
                    del held[k]
        if not held:
            return [found.get(k) for k in wanted], n, low, high
        parts = _parts(values, sorted(set(held.values()), key=lambda s: s.before))
        held = {k: next(p for p in parts[s] if p.before <= k < p.before + p.rows) for k, s in held.items()}
