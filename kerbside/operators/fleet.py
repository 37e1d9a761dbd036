"""Moving fleets: who is under way at an instant, where, and which streets a fleet enters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geo
from kerbside.operators import sequence, spatial

#: Metres between the samples of a path; reach of the nearest street.
SAMPLE_M, SNAP_M = 16.0, 35.0


def active_at(trips: DataFrame, instants: DataFrame, start: str, duration: str, longest: float | None = None) -> DataFrame:
    """trips with each instants(now) at which they are under way: start <= now < start + duration.

    An interval index: trips lie in buckets of their start, as wide as the longest trip, and an instant asks its own bucket
    and the one before; an equi-join whatever the number of instants. longest: of all durations; found by an aggregate if not
    given."""
    if longest is None:
        longest = trips.agg(F.max(F.col(duration).cast("double"))).first()[0] or 1.0
    width = F.lit(max(float(longest), 1e-9))
    asked = instants.select("now", F.explode(F.array(F.floor(F.col("now") / width), F.floor(F.col("now") / width) - 1)).alias("__b"))
    dealt = trips.where(F.col(duration) > 0).withColumn("__b", F.floor(F.col(start) / width))
    return dealt.join(asked, "__b").where((F.col(start) <= F.col("now")) & (F.col("now") < F.col(start) + F.col(duration))).drop("__b")


def arc_at_share(wanted: DataFrame, points: DataFrame, key: str, share: str = "f") -> DataFrame:
    """wanted(key, share) with `arc`, the length reached at the share of the travel time: the inverse of the pace profile."""
    s = sequence.spans(sequence.paced(points, key), key, "time_frac", "cum_m")
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(share)))
    out = wanted.join(s, key).where((f >= F.col("a0")) & ((f < F.col("a1")) | ((F.col("a1") >= F.col("end")) & (f <= F.col("a1")))))
    t = F.when(F.col("a1") > F.col("a0"), (f - F.col("a0")) / (F.col("a1") - F.col("a0"))).otherwise(0.0)
    return out.select(*wanted.columns, geo.lerp("cum_m0", "cum_m1", t).alias("arc"))


def positions(trips: DataFrame, instants: DataFrame, points: DataFrame, key: str, start: str, duration: str) -> DataFrame:
    """trips(key: their route) that are under way at each instant, with x, y."""
    share = (F.col("now") - F.col(start)) / F.col(duration)
    under_way = active_at(trips, instants, start, duration).withColumn("f", share)
    return sequence.at_arc(arc_at_share(under_way, points, key), points, key)


def street_entries(points: DataFrame, edges: DataFrame, key: str, step: float = SAMPLE_M, reach: float = SNAP_M) -> DataFrame:
    """(key, edge_id, entries) of paths along edges(edge_id, x0, y0, x1, y1): a path is sampled at most `step` apart, each
    sample belongs to the nearest edge within reach, and an edge is entered where it differs from the last one before; samples
    off the street carry the last edge over."""
    total = sequence.measured(points, key).groupBy(key).agg(F.max("cum_m").alias("total"))
    n = F.greatest(F.lit(1), F.ceil(F.col("total") / step)).cast("int")
    samples = total.select(key, "total", n.alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).select(key, "k", (F.col("total") * F.col("k") / F.col("n")).alias("arc"))
    placed = sequence.at_arc(samples, points, key).select(F.struct(key, "k").alias("sample"), "x", "y")
    snapped = spatial.nearest_edge(placed, edges, "sample", reach).select(f"sample.{key}", "sample.k", "edge_id")
    before = F.lag("edge_id").over(sequence.over(key, "k"))
    entered = snapped.withColumn("before", before).where("before IS NULL OR before <> edge_id")
    return entered.groupBy(key, "edge_id").agg(F.count("*").alias("entries"))
