"""Ordered sequences: routes, paces, keyframes, runs. Windows are by key and stream; none spans the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import geo


def over(key: str | list[str], *order) -> Window:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)


def running(key, *order) -> Window:
    return over(key, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def segments(points: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, seq, x0, y0, x1, y1) of consecutive points."""
    w = over(key, seq)
    out = points.select(key, seq, F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    return out.where("x1 IS NOT NULL")


def measured(points: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """points with cum_m, the length from the start."""
    w = over(key, seq)
    step = F.coalesce(geo.distance("x", "y", F.lag("x").over(w), F.lag("y").over(w)), F.lit(0.0))
    return points.withColumn("step_m", step).withColumn("cum_m", F.sum("step_m").over(running(key, seq)))


def paced(points: DataFrame, key: str, limit: float = 11.176, least: float = 0.3, seq: str = "seq") -> DataFrame:
    """measured points with time_frac: the share of travel time at each, slowing to `least` of the limit in sharp turns; a
    segment is travelled at the slower of its ends."""
    w = over(key, seq)
    out = measured(points, key, seq).withColumns({"inx": F.col("x") - F.lag("x").over(w), "iny": F.col("y") - F.lag("y").over(w), "outx": F.lead("x").over(w) - F.col("x"), "outy": F.lead("y").over(w) - F.col("y")})
    (ax, ay), (bx, by) = geo.normalized("inx", "iny"), geo.normalized("outx", "outy")
    straight = geo.clamp((ax * bx + ay * by + 1) / 2, 0.0, 1.0)
    out = out.withColumn("factor", F.when(F.col("inx").isNull() | F.col("outx").isNull(), 1.0).otherwise(least + (1 - least) * straight))
    dt = F.coalesce(F.col("step_m") / F.greatest(F.least("factor", F.lag("factor").over(w)) * max(limit, 0.1), F.lit(1e-6)), F.lit(0.0))
    out = out.withColumn("dt", dt).withColumn("t", F.sum("dt").over(running(key, seq)))
    total = F.sum("dt").over(Window.partitionBy(key))
    return out.withColumn("time_frac", F.when(total > 0, F.col("t") / total).otherwise(0.0)).drop("inx", "iny", "outx", "outy", "dt", "t", "factor")


def spans(points: DataFrame, key: str, at: str, *values: str, seq: str = "seq") -> DataFrame:
    """Rows (key, seq, a0, a1, last, v0, v1 of each value): the stretch from each point to the next by `at`."""
    w = over(key, seq)
    out = points.select(key, seq, F.col(at).alias("a0"), F.lead(at).over(w).alias("a1"), *(c for v in values for c in (F.col(v).alias(f"{v}0"), F.lead(v).over(w).alias(f"{v}1"))), F.max(at).over(Window.partitionBy(key)).alias("end"))
    return out.where("a1 IS NOT NULL")


def at_arc(wanted: DataFrame, points: DataFrame, key: str, arc: str = "arc", seq: str = "seq") -> DataFrame:
    """wanted(key, arc, ...) with the point x, y at that length, clamped to the route: an equi-join on the route with the one
    stretch that holds the arc."""
    s = spans(measured(points, key, seq), key, "cum_m", "x", "y", seq=seq).withColumnRenamed(seq, "__seq")
    joined = wanted.join(s, key).withColumn("__a", F.greatest(F.lit(0.0), F.least(F.col(arc), F.col("end"))))
    here = (F.col("__a") >= F.col("a0")) & ((F.col("__a") < F.col("a1")) | ((F.col("a1") == F.col("end")) & (F.col("__a") <= F.col("a1"))))
    t = F.when(F.col("a1") > F.col("a0"), (F.col("__a") - F.col("a0")) / (F.col("a1") - F.col("a0"))).otherwise(0.0)
    return joined.where(here).withColumns({"x": geo.lerp("x0", "x1", t), "y": geo.lerp("y0", "y1", t)}).drop("a0", "a1", "x0", "x1", "y0", "y1", "end", "__a", "__seq")


def headings(wanted: DataFrame, points: DataFrame, key: str, arc: str = "arc", seq: str = "seq") -> DataFrame:
    """wanted with hx, hy: the direction between the points half a metre on either side."""
    ids = [c for c in wanted.columns]
    a = at_arc(wanted.withColumn("__b", F.col(arc) - 0.5), points, key, "__b", seq).select(*ids, F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = at_arc(wanted.withColumn("__b", F.col(arc) + 0.5), points, key, "__b", seq).select(*ids, F.col("x").alias("xb"), F.col("y").alias("yb"))
    hx, hy = geo.normalized(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya"))
    return a.join(b, ids).withColumns({"hx": hx, "hy": hy}).drop("xa", "xb", "ya", "yb")


def ticks(routes: DataFrame, duration: str, dt: float = 1.0, exact: bool = False) -> DataFrame:
    """routes with t and weight: t = 0, dt, ... below the duration, and the end with its partial weight. Weights sum to the
    duration and dt; with `exact` the first tick is left out, and they sum to the duration."""
    d = F.col(duration)
    n = F.ceil(d / dt).cast("int")
    out = routes.withColumn("__k", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(0)))))
    t = F.least(F.col("__k") * F.lit(dt), d)
    weight = F.when(F.col("__k") < n, F.lit(dt)).otherwise(d - (n - 1) * F.lit(dt))
    out = out.withColumns({"t": t, "weight": F.when(n == 0, 0.0).otherwise(weight), "tick": F.col("__k").cast("long")})
    return (out.where("tick > 0") if exact else out).drop("__k")


def islands(rows: DataFrame, key: str | list[str], flag: Column, *order) -> DataFrame:
    """rows with `entry`, true where a run of flag begins, and `run`, the number of runs so far."""
    before = F.lag(flag, 1, False).over(over(key, *order))
    out = rows.withColumn("entry", flag & ~before)
    return out.withColumn("run", F.sum(F.col("entry").cast("long")).over(running(key, *order)))


def dwelled(a0, a1, t0, t1, now, dwell_min: float = 0.25, dwell_frac: float = 0.4) -> Column:
    """Position between two stops: smoothstep travel, then dwell at the second for min(dwell_min, dwell_frac of the time)."""
    seg = geo.col(t1) - geo.col(t0)
    travel = F.greatest(seg - F.least(F.lit(dwell_min), seg * dwell_frac), F.lit(1e-4))
    f = geo.clamp((geo.col(now) - geo.col(t0)) / travel, 0.0, 1.0)
    return F.when(seg <= 0, geo.col(a1)).otherwise(geo.lerp(a0, a1, f * f * (3 - 2 * f)))


def keyframed(wanted: DataFrame, frames: DataFrame, key: str = "trip_id", now: str = "now") -> DataFrame:
    """wanted(key, now) with `arc`: clamped before the first and after the last frame, else dwelled in the first stretch
    that holds now."""
    s = spans(frames, key, "time_min", "stop_arc")
    edge = frames.groupBy(key).agg(F.min_by("stop_arc", F.struct("seq")).alias("first"), F.max_by("stop_arc", F.struct("seq")).alias("final"), F.min("time_min").alias("t_first"), F.max("time_min").alias("t_last"))
    ids = wanted.columns
    held = wanted.join(s, key).where(F.col(now).between(F.col("a0"), F.col("a1")))
    held = held.withColumn("arc", dwelled("stop_arc0", "stop_arc1", "a0", "a1", now)).groupBy(*ids).agg(F.min_by("arc", "seq").alias("mid"))
    out = wanted.join(edge, key).join(held, ids, "left")
    return out.select(*ids, F.when(F.col(now) <= F.col("t_first"), F.col("first")).when(F.col(now) >= F.col("t_last"), F.col("final")).otherwise(F.col("mid")).alias("arc"))


def prefix_over_buckets(df: DataFrame, bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """A running sum over the whole table in `order`, in two levels: sums within buckets that follow the order, and the
    buckets' totals before them. Only bucket totals meet in one task."""
    b = df.withColumn("__b", bucket)
    inner = b.withColumn("__in", F.sum(value).over(running("__b", *order)))
    totals = b.groupBy("__b").agg(F.sum(value).alias("__s"))
    before = totals.withColumn("__before", F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)))
    return inner.join(before.select("__b", F.coalesce("__before", F.lit(0)).alias("__before")), "__b").withColumn(out, F.col("__in") + F.col("__before")).drop("__b", "__in", "__before")
