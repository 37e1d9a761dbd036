"""Window functions, ordered sequences, limits, sampling and set operations."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import geo
from kerbside.operators import fleet, geometry, graph, sequence, spatial

from .registry import query
from .scalars import SEGMENTS, r
from .views import Tables

CUM = "SELECT route_id, seq, x, y, SUM(COALESCE(SQRT((x - px) ** 2 + (y - py) ** 2), 0.0e0)) OVER (PARTITION BY route_id ORDER BY seq) AS cum FROM (SELECT *, LAG(x) OVER (PARTITION BY route_id ORDER BY seq) AS px, LAG(y) OVER (PARTITION BY route_id ORDER BY seq) AS py FROM v_route_points) q"
STRETCH = f"SELECT route_id, seq, cum AS a0, LEAD(cum) OVER (PARTITION BY route_id ORDER BY seq) AS a1, x AS x0, y AS y0, LEAD(x) OVER (PARTITION BY route_id ORDER BY seq) AS x1, LEAD(y) OVER (PARTITION BY route_id ORDER BY seq) AS y1, MAX(cum) OVER (PARTITION BY route_id) AS total FROM ({CUM}) c"
AT = "CAST(route_id * 37 % 180 AS DOUBLE)"


@query("win_cumulative_length", f"SELECT route_id, seq, ROUND(cum, 6) AS cum_m FROM ({CUM}) c")
def win_cumulative_length(t: Tables) -> DataFrame:
    return sequence.measured(t.route_points, "route_id").select("route_id", "seq", F.round("cum_m", 6).alias("cum_m"))


@query("win_pairs", f"SELECT route_id, seq, x0, y0, x1, y1 FROM ({SEGMENTS}) s WHERE x1 IS NOT NULL")
def win_pairs(t: Tables) -> DataFrame:
    return sequence.segments(t.route_points, "route_id")


def _arcs(t: Tables) -> DataFrame:
    return t.route_points.select("route_id").distinct().withColumn("arc", F.expr(AT))


@query("win_position_at", f"SELECT route_id, ROUND(x0 + (x1 - x0) * (a - a0) / (a1 - a0), 6) + 0.0e0 AS x, ROUND(y0 + (y1 - y0) * (a - a0) / (a1 - a0), 6) + 0.0e0 AS y FROM (SELECT *, LEAST({AT}, total) AS a FROM ({STRETCH}) s WHERE a1 IS NOT NULL) q WHERE a >= a0 AND (a < a1 OR (a1 = total AND a <= a1))")
def win_position_at(t: Tables) -> DataFrame:
    return sequence.at_arc(_arcs(t), t.route_points, "route_id").select("route_id", r("x").alias("x"), r("y").alias("y"))


@query("win_heading_at", f"SELECT route_id, ROUND((x1 - x0) / (a1 - a0), 4) + 0.0e0 AS hx, ROUND((y1 - y0) / (a1 - a0), 4) + 0.0e0 AS hy FROM (SELECT *, a0 + (a1 - a0) / 2 AS a FROM ({STRETCH}) s WHERE a1 IS NOT NULL) q WHERE seq = 2")
def win_heading_at(t: Tables) -> DataFrame:
    mid = sequence.spans(sequence.measured(t.route_points, "route_id"), "route_id", "cum_m").where("seq = 2").select("route_id", ((F.col("a0") + F.col("a1")) / 2).alias("arc"))
    return sequence.headings(mid, t.route_points, "route_id").select("route_id", r("hx", 4).alias("hx"), r("hy", 4).alias("hy"))


@query("win_sample_over_time", f"SELECT route_id, CAST(k AS BIGINT) AS tick, ROUND(LEAST(k * 1.0e0, d), 6) AS t, ROUND(CASE WHEN k < CEIL(d) THEN 1.0e0 ELSE d - (CEIL(d) - 1) END, 6) AS weight FROM (SELECT route_id, MAX(cum) / 1.34e0 AS d FROM ({CUM}) c GROUP BY route_id) q CROSS JOIN (SELECT UNNEST(RANGE(0, 400)) AS k) n WHERE k <= CEIL(d)")
def win_sample_over_time(t: Tables) -> DataFrame:
    d = sequence.measured(t.route_points, "route_id").groupBy("route_id").agg((F.max("cum_m") / 1.34).alias("d"))
    return sequence.ticks(d, "d").select("route_id", "tick", F.round("t", 6).alias("t"), F.round("weight", 6).alias("weight"))


@query("win_step_progress", "SELECT event_id, ROUND(SQRT((x - LAG(x) OVER w) ** 2 + (y - LAG(y) OVER w) ** 2), 6) AS step FROM v_pings WINDOW w AS (PARTITION BY agent_id ORDER BY ts, event_id)")
def win_step_progress(t: Tables) -> DataFrame:
    w = sequence.over("agent_id", "ts", "event_id")
    return t.pings.select("event_id", F.round(geo.distance("x", "y", F.lag("x").over(w), F.lag("y").over(w)), 6).alias("step"))


PACE = f"""SELECT route_id, seq, ROUND(SUM(dt) OVER (PARTITION BY route_id ORDER BY seq) / SUM(dt) OVER (PARTITION BY route_id), 6) AS frac, SUM(dt) OVER (PARTITION BY route_id ORDER BY seq) / SUM(dt) OVER (PARTITION BY route_id) AS raw, cum FROM
  (SELECT *, COALESCE(len / (11.176e0 * LEAST(fac, LAG(fac) OVER (PARTITION BY route_id ORDER BY seq))), 0.0e0) AS dt FROM (SELECT *, CASE WHEN ix IS NULL OR ox IS NULL THEN 1.0e0 ELSE 0.3e0 + 0.7e0 * GREATEST(0.0e0, LEAST(1.0e0, ((ix * ox + iy * oy) / (SQRT(ix * ix + iy * iy) * SQRT(ox * ox + oy * oy)) + 1) / 2)) END AS fac, SQRT(ix * ix + iy * iy) AS len FROM
  (SELECT route_id, seq, cum, x - LAG(x) OVER w AS ix, y - LAG(y) OVER w AS iy, LEAD(x) OVER w - x AS ox, LEAD(y) OVER w - y AS oy FROM ({CUM}) c WINDOW w AS (PARTITION BY route_id ORDER BY seq)) p) f) d"""


@query("win_pace_profile", f"SELECT route_id, seq, frac FROM ({PACE}) p")
def win_pace_profile(t: Tables) -> DataFrame:
    return sequence.paced(t.route_points, "route_id").select("route_id", "seq", F.round("time_frac", 6).alias("frac"))


FRAC = "(route_id * 29 % 97) / 100.0e0 + 0.005e0"


@query("win_arc_at", f"SELECT route_id, ROUND(cum + (c1 - cum) * (f - raw) / (r1 - raw), 4) AS arc FROM (SELECT *, {FRAC} AS f, LEAD(raw) OVER (PARTITION BY route_id ORDER BY seq) AS r1, LEAD(cum) OVER (PARTITION BY route_id ORDER BY seq) AS c1 FROM ({PACE}) p) q WHERE f >= raw AND f < r1")
def win_arc_at(t: Tables) -> DataFrame:
    return fleet.arc_at_share(t.route_points.select("route_id").distinct().withColumn("f", F.expr(FRAC)), t.route_points, "route_id").select("route_id", F.round("arc", 4).alias("arc"))


@query("win_monotone_max", "SELECT trip_id, seq, MAX(stop_arc) OVER (PARTITION BY trip_id ORDER BY seq) AS arc FROM v_keyframes")
def win_monotone_max(t: Tables) -> DataFrame:
    return t.keyframes.select("trip_id", "seq", F.max("stop_arc").over(sequence.running("trip_id", "seq")).alias("arc"))


STOPS = "SELECT route_id, seq AS stop, x + 7.0e0 AS px, y - 5.0e0 AS py FROM v_route_points WHERE seq % 2 = 1"


@query("win_project_arc", f"""SELECT route_id, stop, ROUND(a0 + tt * (a1 - a0), 4) AS arc FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY route_id, stop ORDER BY ROUND((px - x0 - tt * (x1 - x0)) ** 2 + (py - y0 - tt * (y1 - y0)) ** 2, 6), seq) AS rn FROM
  (SELECT s.*, p.stop, p.px, p.py, GREATEST(0.0e0, LEAST(1.0e0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS tt FROM ({STRETCH}) s JOIN ({STOPS}) p ON p.route_id = s.route_id WHERE a1 IS NOT NULL) q) w WHERE rn = 1""")
def win_project_arc(t: Tables) -> DataFrame:
    return project_arc(t.sql(STOPS), t.route_points, "route_id", "stop").select("route_id", "stop", F.round("arc", 4).alias("arc"))


def project_arc(stops: DataFrame, points: DataFrame, key: str, stop: str) -> DataFrame:
    """(key, stop, arc): where along its shape the point nearest to each stop (px, py) lies; the first on ties."""
    s = sequence.spans(sequence.measured(points, key), key, "cum_m", "x", "y")
    tt = geo.along("px", "py", "x0", "y0", "x1", "y1")
    d2 = geo.distance2("px", "py", geo.lerp("x0", "x1", tt), geo.lerp("y0", "y1", tt))
    best = F.min(F.struct(F.round(d2, 6).alias("d2"), "seq", geo.lerp("a0", "a1", tt).alias("arc"))).alias("b")
    return stops.join(s, key).groupBy(key, stop).agg(best).select(key, stop, "b.arc")


VISITS = "SELECT agent_id, event_id, ts, x, y, CAST(FLOOR((x + 1000.0e0) / 500.0e0) AS BIGINT) AS edge FROM v_pings"


@query("win_fresh_entry", f"SELECT agent_id, edge, COUNT(*) AS entries FROM (SELECT *, LAG(edge) OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS before FROM ({VISITS}) v) q WHERE before IS NULL OR before <> edge GROUP BY agent_id, edge")
def win_fresh_entry(t: Tables) -> DataFrame:
    return fresh_entries(t.sql(VISITS), "agent_id", "edge", "ts", "event_id").groupBy("agent_id", "edge").agg(F.count("*").alias("entries"))


def fresh_entries(rows: DataFrame, key: str, edge: str, *order: str) -> DataFrame:
    """Rows whose edge differs from the last one before that was not null."""
    before = F.last(edge, ignorenulls=True).over(sequence.over(key, *order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__b", before).where(F.col(edge).isNotNull() & (F.col("__b").isNull() | (F.col("__b") != F.col(edge)))).drop("__b")


@query("win_debounced_pass", "SELECT agent_id, COUNT(*) AS passes FROM (SELECT agent_id, inside, LAG(inside, 1, FALSE) OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS before FROM (SELECT *, x * x + y * y <= 360000.0e0 AS inside FROM v_pings) i) q WHERE inside AND NOT before GROUP BY agent_id")
def win_debounced_pass(t: Tables) -> DataFrame:
    passes = sequence.islands(t.pings, "agent_id", geo.distance2("x", "y", 0.0, 0.0) <= 360000.0, "ts", "event_id")
    return passes.where("entry").groupBy("agent_id").agg(F.count("*").alias("passes"))


SWEPT = "SELECT event_id, x AS bx, y AS by_, COALESCE(LAG(x) OVER w, x) AS ax, COALESCE(LAG(y) OVER w, y) AS ay FROM v_pings WINDOW w AS (PARTITION BY agent_id ORDER BY ts, event_id)"
STT = "GREATEST(0.0e0, LEAST(1.0e0, ((0 - ax) * (bx - ax) + (0 - ay) * (by_ - ay)) / NULLIF((bx - ax) ** 2 + (by_ - ay) ** 2, 0)))"


@query("win_swept_capture", f"SELECT event_id, ROUND(SQRT((ax + COALESCE(tt, 0) * (bx - ax)) ** 2 + (ay + COALESCE(tt, 0) * (by_ - ay)) ** 2), 6) AS d FROM (SELECT *, CASE WHEN (bx - ax) ** 2 + (by_ - ay) ** 2 > 360000.0e0 THEN 1.0e0 ELSE {STT} END AS tt FROM ({SWEPT}) s) q")
def win_swept_capture(t: Tables) -> DataFrame:
    s = t.sql(SWEPT)
    jump = geo.distance2("ax", "ay", "bx", "by_") > 360000.0
    return s.select("event_id", F.round(F.when(jump, geo.length("bx", "by_")).otherwise(geo.point_segment_distance(0.0, 0.0, "ax", "ay", "bx", "by_")), 6).alias("d"))


DWELL = "SELECT trip_id, seq, time_min AS t0, LEAD(time_min) OVER w AS t1, stop_arc AS a0, LEAD(stop_arc) OVER w AS a1 FROM v_keyframes WINDOW w AS (PARTITION BY trip_id ORDER BY seq)"


@query("win_stop_dwell", f"SELECT trip_id, seq, ROUND(a0 + (a1 - a0) * f * f * (3 - 2 * f), 6) AS arc FROM (SELECT *, GREATEST(0.0e0, LEAST(1.0e0, (t0 + (t1 - t0) * 0.6e0 - t0) / ((t1 - t0) - LEAST(0.25e0, (t1 - t0) * 0.4e0)))) AS f FROM ({DWELL}) d WHERE t1 IS NOT NULL) q")
def win_stop_dwell(t: Tables) -> DataFrame:
    s = sequence.spans(t.keyframes, "trip_id", "time_min", "stop_arc")
    arc = sequence.dwelled("stop_arc0", "stop_arc1", "a0", "a1", geo.lerp("a0", "a1", 0.6))
    return s.select("trip_id", "seq", F.round(arc, 6).alias("arc"))


@query("win_cumulative_weights", "SELECT facility_id, ROUND(SUM(w) OVER (ORDER BY facility_id), 6) AS cum FROM (SELECT facility_id, POWER(facility_id % 10 / 10.0e0, 2) + 0.02e0 AS w FROM v_facilities) q")
def win_cumulative_weights(t: Tables) -> DataFrame:
    w = t.facilities.select("facility_id", F.expr("POWER(facility_id % 10 / 10.0e0, 2) + 0.02e0").alias("w"))
    return sequence.prefix_over_buckets(w, F.floor(F.col("facility_id") / 1024), ["facility_id"], "w", "cum").select("facility_id", F.round("cum", 6).alias("cum"))


@query("win_decimate_distance", """WITH RECURSIVE kept AS (SELECT route_id, seq, x, y FROM v_route_points WHERE seq = 0 UNION ALL
  SELECT k.route_id, n.seq, n.x, n.y FROM kept k CROSS JOIN LATERAL (SELECT p.seq, p.x, p.y FROM v_route_points p WHERE p.route_id = k.route_id AND p.seq > k.seq AND ((p.x - k.x) ** 2 + (p.y - k.y) ** 2 > 4900.0e0 OR p.seq = 5) ORDER BY p.seq LIMIT 1) n)
  SELECT route_id, COUNT(*) AS kept, ROUND(SUM(x), 4) + 0.0e0 AS sx FROM kept GROUP BY route_id""")
def win_decimate_distance(t: Tables) -> DataFrame:
    kept = geometry.decimated(F.col("ring"), 70.0)
    rows = geometry.rings(t.route_points, "route_id", "seq").select("route_id", F.explode(kept).alias("p"))
    return rows.groupBy("route_id").agg(F.count("*").alias("kept"), r(F.sum("p.x"), 4).alias("sx"))


@query("win_offshore_spread", """WITH RECURSIVE ord AS (SELECT side, y, CAST(ROW_NUMBER() OVER (PARTITION BY side ORDER BY y, zone_id) AS BIGINT) AS k FROM (SELECT zone_id, zone_id % 2 AS side, (zone_id * 37 % 200) / 1.0e0 AS y FROM v_zones) z),
  pushed AS (SELECT side, k, y FROM ord WHERE k = 1 UNION ALL SELECT o.side, o.k, GREATEST(o.y, p.y + 12.0e0) FROM pushed p JOIN ord o ON o.side = p.side AND o.k = p.k + 1) SELECT side, k, y FROM pushed""")
def win_offshore_spread(t: Tables) -> DataFrame:
    z = t.zones.select((F.col("zone_id") % 2).alias("side"), F.expr("(zone_id * 37 % 200) / 1.0e0").alias("y"))
    ys = z.groupBy("side").agg(F.array_sort(F.collect_list("y")).alias("ys"))
    return ys.select("side", F.posexplode(geometry.spread(F.col("ys"), 12.0)).alias("k", "y")).select("side", (F.col("k") + 1).cast("long").alias("k"), "y")


@query("win_rank", "SELECT zone, CAST(ROW_NUMBER() OVER (ORDER BY cameras DESC, zone) AS BIGINT) AS rank FROM (SELECT n_name AS zone, COUNT(*) AS cameras FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name) q")
def win_rank(t: Tables) -> DataFrame:
    n = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("cameras")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return n.select(F.col("n_name").alias("zone"), F.row_number().over(Window.orderBy(F.desc("cameras"), "n_name")).cast("long").alias("rank"))


# Limits and sampling


@query("sort_total", "SELECT trip_id, pu_min FROM v_trips ORDER BY pu_min, trip_id")
def sort_total(t: Tables) -> DataFrame:
    return t.trips.select("trip_id", "pu_min").orderBy("pu_min", "trip_id")


@query("topk_pairs", "SELECT pu_zone, do_zone, COUNT(*) AS trips FROM v_trips GROUP BY 1, 2 ORDER BY trips DESC, pu_zone, do_zone LIMIT 20")
def topk_pairs(t: Tables) -> DataFrame:
    return top_pairs(t.trips, 20)


def top_pairs(trips: DataFrame, n: int, least: int = 1) -> DataFrame:
    """The n most frequent origin-destination pairs with at least `least` trips."""
    return trips.groupBy("pu_zone", "do_zone").agg(F.count("*").alias("trips")).where(F.col("trips") >= least).orderBy(F.desc("trips"), "pu_zone", "do_zone").limit(n)


@query("topk_per_group", "SELECT pu_zone, trip_id FROM (SELECT pu_zone, trip_id, ROW_NUMBER() OVER (PARTITION BY pu_zone ORDER BY dur_min DESC, trip_id) AS rn FROM v_trips) q WHERE rn <= 4")
def topk_per_group(t: Tables) -> DataFrame:
    return top_per(t.trips, ["pu_zone"], 4, F.desc("dur_min"), "trip_id").select("pu_zone", "trip_id")


def top_per(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """The first k rows of each key; Spark cuts the rest within tasks before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


@query("even_spread_sample", "SELECT facility_id FROM (SELECT facility_id, kind, ROW_NUMBER() OVER (PARTITION BY kind ORDER BY x + y, facility_id) - 1 AS rn, COUNT(*) OVER (PARTITION BY kind) AS n FROM v_facilities) q JOIN (SELECT UNNEST(RANGE(0, 6)) AS j) s ON rn = CAST(FLOOR(j * n / 6.0e0) AS BIGINT)")
def even_spread_sample(t: Tables) -> DataFrame:
    return even_spread(t.facilities, "kind", 6, F.col("x") + F.col("y"), F.col("facility_id")).select("facility_id")


def even_spread(df: DataFrame, key: str, k: int, *order) -> DataFrame:
    """The rows at places j * n / k of each key's sorted rows. Places are two-level: within the parts of a range-partitioned sort,
    which is written first so that parts stay as they are, and over each key's counts in the parts; a key may be spread over many."""
    at = graph.checkpointed(df.orderBy(key, *order).withColumn("__at", F.monotonically_increasing_id()))
    at = at.withColumns({"__part": F.shiftright("__at", 33), "__in": F.expr("__at & 8589934591")})
    w = Window.partitionBy("__key")  # a row for each part
    parts = at.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"), F.min("__in").alias("__first"))
    before = F.coalesce(F.sum("__n").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__key", "__p", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(w).alias("__all"))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * F.col("__all") / k))
    found = at.join(parts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p")))
    return found.where(F.array_contains(places, F.col("__in") + F.col("__shift"))).select(*df.columns)


def _halves(z) -> tuple:
    return F.shiftrightunsigned(z, 32), z.bitwiseAND(0xFFFFFFFF)


def _joined(high, low):
    """The long of two halves; what high has beyond 32 bits goes."""
    return F.shiftleft(high, 32).bitwiseOR(low)


def _bound(value, use):
    """use(value), with value computed once and named, so that the expression does not grow with each use of it."""
    return F.transform(F.array(value), use)[0]


def _times(z, factor: int):
    """z * factor modulo 2**64, without a sum or product beyond a long."""
    high, low = _halves(z)
    # the low 16 and the next 16 bits of the factor; a half times either has 48 bits
    f0, f1, top = factor & 0xFFFF, factor >> 16 & 0xFFFF, factor >> 32
    by = lambda x, a, b: x * a + F.shiftleft((x * b).bitwiseAND(0xFFFF), 16)
    inner = by(low, f0, f1)
    upper = F.shiftright(inner, 32) + F.shiftright(low * f1, 16) + by(high, f0, f1) + by(low, top & 0xFFFF, top >> 16)
    return _joined(upper, inner.bitwiseAND(0xFFFFFFFF))


def splitmix64(k):
    """A uniform [0, 1) double of a long, by splitmix64 in wrapping 64-bit arithmetic."""

    def last(z):
        high, low = _halves(z.bitwiseXOR(F.shiftrightunsigned(z, 31)))
        return (high.cast("double") * 2.0**32 + low.cast("double")) / 2.0**64

    high, low = _halves(k)
    low = low + 0x7F4A7C15
    z = _joined(high + 0x9E3779B9 + F.shiftright(low, 32), low.bitwiseAND(0xFFFFFFFF))
    z = _bound(z, lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, 30)))
    z = _bound(z, lambda z: _times(z, 0xBF58476D1CE4E5B9))
    z = _bound(z, lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, 27)))
    return _bound(_bound(z, lambda z: _times(z, 0x94D049BB133111EB)), last)


def _mixed_sql(z: str, shift: int, factor: str) -> str:
    """z xor-ed with itself shifted, times factor, modulo 2**64; all as whole numbers."""
    return f"CAST((CAST(XOR({z}, {z} >> {shift}) AS UHUGEINT) * CAST('{factor}' AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT) AS UBIGINT)"


RESERVOIR = f"""WITH z0 AS (SELECT facility_id, kind, CAST((CAST(facility_id AS UHUGEINT) + CAST('11400714819323198485' AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT) AS UBIGINT) AS z FROM v_facilities),
  z1 AS (SELECT facility_id, kind, {_mixed_sql('z', 30, '13787848793156543929')} AS z FROM z0), z2 AS (SELECT facility_id, kind, {_mixed_sql('z', 27, '10723151780598845931')} AS z FROM z1),
  u AS (SELECT facility_id, kind, CAST(XOR(z, z >> 31) AS DOUBLE) / 18446744073709551616.0e0 AS u FROM z2)
  SELECT kind, facility_id FROM (SELECT kind, facility_id, ROW_NUMBER() OVER (PARTITION BY kind ORDER BY POWER(u, 1 / (SQRT(facility_id % 500 + 20.0e0) + 1)) DESC, facility_id) AS n FROM u) q WHERE n <= 6"""


@query("weighted_reservoir", RESERVOIR)
def weighted_reservoir(t: Tables) -> DataFrame:
    """Six facilities of each kind by weight: the greatest u ** (1 / w)."""
    f = t.facilities.withColumn("key", F.pow(splitmix64(F.col("facility_id")), 1 / (F.sqrt(F.expr("facility_id % 500 + 20.0e0")) + 1)))
    return top_per(f, ["kind"], 6, F.desc("key"), "facility_id").select("kind", "facility_id")


@query("weighted_pick", "SELECT p.pick, MIN(c.facility_id) AS facility_id FROM (SELECT CAST(UNNEST(RANGE(0, 50)) AS BIGINT) AS pick) p JOIN (SELECT facility_id, SUM(facility_id % 7 + 1) OVER (ORDER BY facility_id) AS cum, SUM(facility_id % 7 + 1) OVER () AS total FROM v_facilities) c ON c.cum > (p.pick * 7919 % 1000) / 1000.0e0 * c.total GROUP BY p.pick")
def weighted_pick(t: Tables) -> DataFrame:
    w = t.facilities.select("facility_id", F.expr("facility_id % 7 + 1").alias("w"))
    c = sequence.prefix_over_buckets(w, F.floor(F.col("facility_id") / 1024), ["facility_id"], "w", "cum")
    picks = t.spark.range(50).select(F.col("id").alias("pick"), F.expr("(id * 7919 % 1000) / 1000.0e0").alias("u")).crossJoin(F.broadcast(w.agg(F.sum("w").alias("total")))).withColumn("at", F.col("u") * F.col("total"))
    # the stretch (cum - w, cum] that holds the pick, met by hundreds
    boxed = c.withColumn("h", F.explode(F.sequence(F.floor((F.col("cum") - F.col("w")) / 100), F.floor(F.col("cum") / 100))))
    hit = picks.withColumn("h", F.floor(F.col("at") / 100)).join(boxed.select("facility_id", "cum", "w", "h"), "h").where("cum > at AND cum - w <= at")
    return hit.select("pick", "facility_id")


@query("pool_admission")
def pool_admission(t: Tables) -> DataFrame:
    """Trips by start into 40 slots of their zone; one that finds none free is dropped. Slots are kept as ends in a heap."""

    def admit(pdf: pd.DataFrame) -> pd.DataFrame:
        slots: list[float] = []
        out = []
        for r_ in pdf.sort_values(["pu_min", "trip_id"]).itertuples(index=False):
            while slots and slots[0] <= r_.pu_min:
                heapq.heappop(slots)
            if len(slots) < 40:
                heapq.heappush(slots, r_.pu_min + r_.dur_min)
                out.append((r_.trip_id, r_.pu_zone))
        return pd.DataFrame(out, columns=["trip_id", "pu_zone"])

    return t.trips.select("trip_id", "pu_zone", "pu_min", "dur_min").groupBy("pu_zone").applyInPandas(admit, "trip_id long, pu_zone long")


@query("first_n_results", "SELECT sensor_id FROM v_sensors WHERE x > 0 ORDER BY sensor_id LIMIT 6")
def first_n_results(t: Tables) -> DataFrame:
    return t.sensors.where("x > 0").orderBy("sensor_id").limit(6).select("sensor_id")


@query("seek_window", "SELECT trip_id FROM v_trips WHERE pu_min BETWEEN 480 - 240 AND 480 AND pu_min + dur_min > 480")
def seek_window(t: Tables) -> DataFrame:
    return t.trips.where("pu_min BETWEEN 240 AND 480 AND pu_min + dur_min > 480").select("trip_id")


# Set operations


@query("set_union_all", "SELECT CAST(ROW_NUMBER() OVER (ORDER BY layer, id) - 1 AS BIGINT) AS n, layer, id FROM (SELECT 1 AS layer, CAST(c_custkey AS BIGINT) AS id FROM customer UNION ALL SELECT 2, CAST(s_suppkey AS BIGINT) FROM supplier) q")
def set_union_all(t: Tables) -> DataFrame:
    layers = t.sql("SELECT 1 AS layer, CAST(c_custkey AS BIGINT) AS id FROM customer").unionByName(t.sql("SELECT 2 AS layer, CAST(s_suppkey AS BIGINT) AS id FROM supplier"))
    out = sequence.prefix_over_buckets(layers.withColumn("one", F.lit(1).cast("long")), F.col("layer") * 1_000_000 + F.floor(F.col("id") / 65536), ["layer", "id"], "one", "n")
    return out.select((F.col("n") - 1).alias("n"), "layer", "id")


@query("set_union_except", "SELECT DISTINCT c_custkey AS service FROM customer WHERE (c_custkey % 3 = 0 OR (c_custkey % 5 = 0 AND c_custkey % 10 <> 0)) AND NOT (c_custkey % 10 = 0 OR (c_custkey % 7 = 0 AND c_custkey % 5 <> 0))")
def set_union_except(t: Tables) -> DataFrame:
    ids = t.customer.select(F.col("c_custkey").alias("service"))
    exceptions = ids.where("service % 7 = 0").select("service", F.lit(1).alias("ord"), F.lit(2).alias("kind")).union(ids.where("service % 5 = 0").select("service", F.lit(2), F.when(F.col("service") % 10 == 0, 2).otherwise(1)))
    return active_services(ids.where("service % 3 = 0"), exceptions)


def active_services(weekday: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Services of the weekday, and those that the last of their exceptions(service, ord, kind) adds (1), not those it removes (2)."""
    last = exceptions.groupBy("service").agg(F.max_by("kind", "ord").alias("kind"))
    added, removed = last.where("kind = 1").select("service"), last.where("kind = 2").select("service")
    return weekday.join(removed, "service", "left_anti").select("service").union(added).distinct()


@query("set_distinct_first", "SELECT k, MIN(id) AS id FROM (SELECT CONCAT(CAST(ROUND(x / 50) AS BIGINT), '/', CAST(ROUND(y / 50) AS BIGINT)) AS k, sensor_id AS id FROM v_sensors) q GROUP BY k")
def set_distinct_first(t: Tables) -> DataFrame:
    k = F.concat(F.round(F.col("x") / 50).cast("long").cast("string"), F.lit("/"), F.round(F.col("y") / 50).cast("long").cast("string"))
    return spatial.first_per(t.sensors.select(k.alias("k"), F.col("sensor_id").alias("id")), ["k"], "id")


@query("set_distinct_sort", "SELECT DISTINCT pu_zone, do_zone FROM v_trips ORDER BY 1, 2")
def set_distinct_sort(t: Tables) -> DataFrame:
    return t.trips.select("pu_zone", "do_zone").distinct().orderBy("pu_zone", "do_zone")


@query("set_replicate", "SELECT node_id, CAST(k AS BIGINT) AS k FROM v_nodes CROSS JOIN (SELECT UNNEST(RANGE(1, 5)) AS k) n WHERE k <= CAST(ROUND((node_id % 9) / 2.0e0) AS BIGINT)")
def set_replicate(t: Tables) -> DataFrame:
    return replicated(t.nodes, F.expr("(node_id % 9) / 2.0e0")).select("node_id", "k")


def replicated(rows: DataFrame, median) -> DataFrame:
    """Each row round(median) times, numbered k from 1."""
    n = F.round(median).cast("int")
    return rows.where(n > 0).withColumn("k", F.explode(F.sequence(F.lit(1), n))).withColumn("k", F.col("k").cast("long"))
