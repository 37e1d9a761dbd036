"""Connected components of a link table by alternating large and small stars; labels are the smallest node reachable."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _tally(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _forest(edges: DataFrame) -> DataFrame:
    """Within each task the links of a batch become stars on their components' smallest nodes: fewer rows, same components."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    up[x] = up.get(y, y)
                    x = y
                return x

            for a, b in zip(*(c.to_pylist() for c in part.columns), strict=True):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
            rows = [(x, root(x)) for x in up]
            rows = [(x, r) for x, r in rows if x != r]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """links(a, b) -> (node, label) for every node with a link; label is the smallest node of its component.

    Each round stars every node's larger neighbours on its smallest neighbour, then its smaller ones: two aggregates by
    node with map-side combine and two equi-joins, whose hot nodes adaptive execution can split. Rounds grow as the
    logarithm of a component's width: `most_rounds` are enough for any that fits a table. Every round is written to the
    shared folder, and the one before deleted.
    """
    edges = common.stored(_forest(links.where("a <> b").select("a", "b")), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = common.stored(large, "star")
        common.discard(edges)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = common.stored(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
        common.discard(large)
        now = _tally(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
