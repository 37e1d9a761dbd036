"""Aggregations. Exact order statistics come from value histograms: distinct values with counts, never a collected list of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import geo, scalar
from kerbside.operators import graph, order, spatial

from .joins import PIP, SITES, edge_ticks, sites
from .registry import query
from .scalars import COVERED, DIM
from .views import Tables


def ranked(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """A row for each distinct value of each key: c its count, upto the rows up to it, n all rows."""
    h = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    return h.withColumns({"upto": F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(w)})


def at_rank(histogram: DataFrame, value: str, index: Column, keys: list[str]) -> DataFrame:
    """The value at a zero-based index of each key's sorted rows."""
    hit = (F.col("upto") > index) & (F.col("upto") - F.col("c") <= index)
    return histogram.groupBy(*keys).agg(F.max(F.when(hit, F.col(value))).alias(value))


@query("agg_group_count", "SELECT pu_zone, do_zone, COUNT(*) AS trips FROM v_trips GROUP BY pu_zone, do_zone")
def agg_group_count(t: Tables) -> DataFrame:
    return t.trip_rows.groupBy("pu_zone", "do_zone").agg(F.count("*").alias("trips"))


@query("agg_group_sum", "SELECT pu_zone, ROUND(SUM(dur_min), 4) AS dur, ROUND(SUM(trip_miles), 4) AS miles FROM v_trips GROUP BY pu_zone")
def agg_group_sum(t: Tables) -> DataFrame:
    return t.trip_rows.groupBy("pu_zone").agg(F.round(F.sum("dur_min"), 4).alias("dur"), F.round(F.sum("trip_miles"), 4).alias("miles"))


@query("agg_upper_median", "SELECT pu_zone, dur_min AS median FROM (SELECT pu_zone, dur_min, ROW_NUMBER() OVER (PARTITION BY pu_zone ORDER BY dur_min) AS rn, COUNT(*) OVER (PARTITION BY pu_zone) AS n FROM v_trips) q WHERE rn = CAST(FLOOR(n / 2.0e0) AS BIGINT) + 1")
def agg_upper_median(t: Tables) -> DataFrame:
    h = ranked(t.trip_rows, "dur_min", ["pu_zone"])
    return at_rank(h, "dur_min", F.floor(F.col("n") / 2), ["pu_zone"]).withColumnRenamed("dur_min", "median")


def upper_median(df: DataFrame, value: str) -> float:
    """sorted[n / 2], at least 1e-12; 1 where df is empty."""
    (got,), *_ = order.at_ranks(df, value, lambda n: [n // 2])
    return 1.0 if got is None else max(got, 1e-12)


def density_intensity(counts: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """(key, intensity): count per area against the upper median of the positive densities, clamped to 0..8; 0 without area."""
    d = areas.join(counts, key, "left").select(key, F.when(F.col("area") > 0, F.coalesce("n", F.lit(0)) / F.col("area")).alias("d"))
    return d.select(key, F.when(F.col("d").isNull(), 0.0).otherwise(geo.clamp(F.col("d") / upper_median(d.where("d > 0"), "d"), 0.0, 8.0)).alias("intensity"))


DENSITY = """SELECT z.zone_id, CASE WHEN z.zone_id % 9 = 0 THEN 0.0e0 ELSE 160000.0e0 + z.zone_id * 1000 END AS area, COALESCE(q.n, 0) AS n FROM v_zones z LEFT JOIN (SELECT pu_zone, COUNT(*) AS n FROM v_trips GROUP BY pu_zone) q ON q.pu_zone = z.zone_id"""
MEDIAN = f"SELECT GREATEST(d, 1.0e-12) AS median FROM (SELECT d, ROW_NUMBER() OVER (ORDER BY d) AS rn, COUNT(*) OVER () AS c FROM (SELECT n / area AS d FROM ({DENSITY}) q WHERE area > 0 AND n > 0) w) v WHERE rn = CAST(FLOOR(c / 2.0e0) AS BIGINT) + 1"


@query("agg_density_intensity", f"SELECT zone_id, ROUND(CASE WHEN area > 0 THEN LEAST(8.0e0, n / area / (SELECT median FROM ({MEDIAN}) m)) ELSE 0.0e0 END, 6) AS intensity FROM ({DENSITY}) q")
def agg_density_intensity(t: Tables) -> DataFrame:
    areas = t.zones.select("zone_id", F.expr("CASE WHEN zone_id % 9 = 0 THEN 0.0e0 ELSE 160000.0e0 + zone_id * 1000 END").alias("area"))
    counts = t.trip_rows.groupBy(F.col("pu_zone").alias("zone_id")).agg(F.count("*").alias("n"))
    return density_intensity(counts, areas, "zone_id").withColumn("intensity", F.round("intensity", 6))


@query("agg_index_percentile", "SELECT MAX(CASE WHEN rn - 1 = CAST(ROUND(0.05e0 * (n - 1)) AS BIGINT) THEN dur_min END) AS lo, MAX(CASE WHEN rn - 1 = CAST(ROUND(0.95e0 * (n - 1)) AS BIGINT) THEN dur_min END) AS hi FROM (SELECT dur_min, ROW_NUMBER() OVER (ORDER BY dur_min) AS rn, COUNT(*) OVER () AS n FROM v_trips) q")
def agg_index_percentile(t: Tables) -> DataFrame:
    return index_range(t.trip_rows, "dur_min")


def index_range(df: DataFrame, value: str) -> DataFrame:
    """lo, hi: the values at round(p * (n - 1)) for 5 and 95 %; all of the range where they coincide."""
    (lo, hi), n, least, most = order.at_ranks(df, value, lambda n: [_rounded(p * (n - 1)) for p in (0.05, 0.95)])
    if n and hi - lo < 1e-9:
        lo, hi = least, max(most, least + 1e-9)
    kind = df.schema[value].dataType.simpleString()
    return df.sparkSession.createDataFrame([(lo, hi)], f"lo {kind}, hi {kind}")


def _rounded(x: float) -> int:
    """To the nearest integer, halves upwards."""
    return math.floor(x + 0.5)


@query("agg_floor_percentile", "SELECT MAX(CASE WHEN rn - 1 = CAST(FLOOR(n * 0.5e0) AS BIGINT) THEN dur_min END) AS p50, MAX(CASE WHEN rn - 1 = CAST(FLOOR(n * 0.9e0) AS BIGINT) THEN dur_min END) AS p90 FROM (SELECT dur_min, ROW_NUMBER() OVER (ORDER BY dur_min) AS rn, COUNT(*) OVER () AS n FROM v_trips) q")
def agg_floor_percentile(t: Tables) -> DataFrame:
    values, *_ = order.at_ranks(t.trip_rows, "dur_min", lambda n: [math.floor(n * p) for p in (0.5, 0.9)])
    return t.spark.createDataFrame([tuple(values)], "p50 double, p90 double")


@query("agg_weighted_percentile", "SELECT MIN(CASE WHEN cum >= 0.5e0 * total THEN v END) AS p50, MIN(CASE WHEN cum >= 0.9e0 * total THEN v END) AS p90 FROM (SELECT v, SUM(w) OVER (ORDER BY v) AS cum, SUM(w) OVER () AS total FROM (SELECT FLOOR(trip_miles * 4) AS v, SUM(dur_min) AS w FROM v_trips GROUP BY 1) h) q")
def agg_weighted_percentile(t: Tables) -> DataFrame:
    h = t.trip_rows.groupBy(F.floor(F.col("trip_miles") * 4).cast("double").alias("v")).agg(F.sum("dur_min").alias("w"))
    q = h.withColumns({"cum": F.sum("w").over(Window.orderBy("v")), "total": F.sum("w").over(Window.partitionBy())})
    return q.agg(*(F.min(F.when(F.col("cum") >= p * F.col("total"), F.col("v"))).alias(n) for p, n in ((0.5, "p50"), (0.9, "p90"))))


ENTROPY = "SELECT geoid, ROUND(COALESCE(-SUM(CASE WHEN n > 0 THEN n * 1.0e0 / total * LN(n * 1.0e0 / total) END), 0.0e0), 6) + 0.0e0 AS entropy FROM (SELECT geoid, n, SUM(n) OVER (PARTITION BY geoid) AS total FROM v_groups) q GROUP BY geoid"


@query("agg_shannon_entropy", ENTROPY)
def agg_shannon_entropy(t: Tables) -> DataFrame:
    return entropy(t.groups).withColumn("entropy", F.round("entropy", 6) + 0.0)


def entropy(groups: DataFrame, key: str = "geoid") -> DataFrame:
    """(key, entropy) of groups(key, n), natural logarithm, as ln N - sum(n ln n) / N: one aggregate, no self-join."""
    n = F.col("n").cast("double")
    out = groups.where("n > 0").groupBy(key).agg(F.sum(n).alias("total"), F.sum(n * F.log(n)).alias("nl"))
    return out.select(key, (F.log("total") - F.col("nl") / F.col("total")).alias("entropy"))


def pearson(x: str, y: str) -> Column:
    """Correlation; null for fewer than two rows or no variance."""
    return F.when((F.count(F.lit(1)) >= 2) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.corr(x, y))


@query("agg_pearson", "SELECT ROUND(CORR(dur_min, trip_miles), 6) AS r FROM v_trips")
def agg_pearson(t: Tables) -> DataFrame:
    return t.trip_rows.agg(F.round(pearson("dur_min", "trip_miles"), 6).alias("r"))


@query("agg_mean_var", "SELECT CASE WHEN COUNT(*) > 100 THEN ROUND(AVG(s), 6) ELSE ROUND(LN(1.8e0), 6) END AS mu, CASE WHEN COUNT(*) > 100 THEN ROUND(LEAST(0.8e0, GREATEST(0.35e0, SQRT(VAR_POP(s)))), 6) ELSE 0.55e0 END AS tau FROM (SELECT LN(dur_min / (trip_miles * 2 + 0.5e0)) AS s FROM v_trips) q")
def agg_mean_var(t: Tables) -> DataFrame:
    return slowdown(t.trips.select(F.log(F.col("dur_min") / (F.col("trip_miles") * 2 + 0.5)).alias("s"))).select(F.round("mu", 6).alias("mu"), F.round("tau", 6).alias("tau"))


def slowdown(logs: DataFrame) -> DataFrame:
    """mu, tau of log-slowdowns s; the prior (ln 1.8, 0.55) for 100 rows or fewer."""
    enough = F.count("s") > 100
    return logs.agg(F.when(enough, F.avg("s")).otherwise(F.log(F.lit(1.8))).alias("mu"), F.when(enough, F.least(F.lit(0.8), F.greatest(F.lit(0.35), F.sqrt(F.var_pop("s"))))).otherwise(0.55).alias("tau"))


CAPTURED = "SELECT edge_id, tick, sensor_id, kind, frame_rate FROM (SELECT * FROM (SELECT edge_id, k AS tick, x0 + (x1 - x0) * k / 10.0e0 AS px, y0 + (y1 - y0) * k / 10.0e0 AS py FROM v_edges CROSS JOIN (SELECT CAST(ROW_NUMBER() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS k FROM nation) n WHERE k <= 10) t JOIN v_sensors s ON ABS(t.px - s.x) <= 30 AND ABS(t.py - s.y) <= 30) q WHERE " + COVERED


def captured(t: Tables) -> DataFrame:
    return spatial.captures(edge_ticks(t), spatial.placed(t.sensors), 30.0, few=True)


@query("agg_distinct_devices", f"SELECT edge_id, kind, COUNT(DISTINCT sensor_id) AS devices, SUM(frame_rate) AS frames FROM ({CAPTURED}) c GROUP BY edge_id, kind")
def agg_distinct_devices(t: Tables) -> DataFrame:
    once = captured(t).groupBy("edge_id", "kind", "sensor_id").agg(F.sum("frame_rate").alias("frames"))
    return once.groupBy("edge_id", "kind").agg(F.count("*").alias("devices"), F.sum("frames").alias("frames"))


GRP = "sensor_id % 50"


@query("agg_bool_or_group", f"SELECT CAST({GRP} AS BIGINT) AS grp, BOOL_OR(kind <> 'FixedCctv') AS confirmed FROM v_sensors GROUP BY 1")
def agg_bool_or_group(t: Tables) -> DataFrame:
    return t.sensors.groupBy(F.expr(GRP).cast("long").alias("grp")).agg(F.bool_or(F.col("kind") != "FixedCctv").alias("confirmed"))


RECALL = 1 / 0.63
GROUPED = f"SELECT edge_id, SUM(CASE WHEN ok THEN 1.0e0 ELSE 1.0e0 / 0.63e0 END) AS devices FROM (SELECT edge_id, {GRP} AS grp, BOOL_OR(kind <> 'FixedCctv') AS ok FROM ({CAPTURED}) c GROUP BY edge_id, {GRP}) q GROUP BY edge_id"


@query("agg_grouped_devices", f"SELECT edge_id, ROUND(devices, 6) AS devices FROM ({GROUPED}) g")
def agg_grouped_devices(t: Tables) -> DataFrame:
    return grouped_devices(captured(t).withColumn("grp", F.expr(GRP)), ["edge_id"]).withColumn("devices", F.round("devices", 6))


def grouped_devices(seen: DataFrame, keys: list[str], factor: float = RECALL) -> DataFrame:
    """Distinct groups by key: one for a confirmed group, the recall factor for another."""
    groups = seen.groupBy(*keys, "grp").agg(F.bool_or(F.col("kind") != "FixedCctv").alias("ok"))
    return groups.groupBy(*keys).agg(F.sum(F.when(F.col("ok"), 1.0).otherwise(factor)).alias("devices"))


@query("agg_headline", f"SELECT edge_id, CAST(GREATEST(0, ROUND(devices + edge_id % 7 / 4.0e0)) AS BIGINT) AS headline FROM ({GROUPED}) g")
def agg_headline(t: Tables) -> DataFrame:
    g = grouped_devices(captured(t).withColumn("grp", F.expr(GRP)), ["edge_id"])
    return g.select("edge_id", headline(F.col("devices"), F.expr("edge_id % 7 / 4.0e0")).alias("headline"))


def headline(grouped: Column, mobile: Column) -> Column:
    return F.greatest(F.lit(0), F.round(grouped + mobile).cast("long"))


@query("agg_fraction_surveilled", f"SELECT e.edge_id, ROUND(COALESCE(c.n, 0) / 11.0e0, 6) AS fraction FROM v_edges e LEFT JOIN (SELECT edge_id, COUNT(DISTINCT tick) AS n FROM ({CAPTURED}) q GROUP BY edge_id) c ON c.edge_id = e.edge_id")
def agg_fraction_surveilled(t: Tables) -> DataFrame:
    n = captured(t).select("edge_id", "tick").distinct().groupBy("edge_id").agg(F.count("*").alias("n"))
    return t.edges.select("edge_id").join(n, "edge_id", "left").select("edge_id", F.round(F.coalesce("n", F.lit(0)) / 11.0, 6).alias("fraction"))


@query("agg_breakdown", f"SELECT q.kind, d.label, ROUND(n * CASE WHEN d.recall_corrected THEN 1.0e0 / 0.63e0 ELSE 1.0e0 END, 6) AS devices, ROUND(1 - EXP(-(n * CASE WHEN d.recall_corrected THEN 1.0e0 / 0.63e0 ELSE 1.0e0 END)), 6) AS p FROM (SELECT kind, COUNT(DISTINCT sensor_id) AS n FROM ({CAPTURED}) c GROUP BY kind) q JOIN ({DIM}) d ON d.kind = q.kind")
def agg_breakdown(t: Tables) -> DataFrame:
    n = captured(t).select("kind", "sensor_id").distinct().groupBy("kind").agg(F.count("*").alias("n"))
    devices = F.col("n") * F.when(F.col("recall_corrected"), RECALL).otherwise(1.0)
    out = n.join(F.broadcast(scalar.source_dim(t.spark)), "kind").withColumn("devices", devices).where("devices > 1e-6")
    return out.select("kind", "label", F.round("devices", 6).alias("devices"), F.round(scalar.p_at_least_one("devices"), 6).alias("p"))


@query("agg_neighborhood_stats", f"SELECT zone_id, COUNT(CASE WHEN kind = 'FixedCctv' THEN 1 END) AS cctv, COUNT(CASE WHEN kind = 'Alpr' THEN 1 END) AS alpr, COUNT(CASE WHEN kind = 'DotLiveView' THEN 1 END) AS dot, ROUND(COUNT(*) / 0.16e0, 6) AS density FROM (SELECT sensor_id, kind, MIN(zone_id) AS zone_id FROM ({PIP}) p GROUP BY sensor_id, kind) q GROUP BY zone_id")
def agg_neighborhood_stats(t: Tables) -> DataFrame:
    first = spatial.first_polygon(t.sensors, t.zone_rings, "sensor_id", "zone_id", 200.0)
    kinds = {"cctv": "FixedCctv", "alpr": "Alpr", "dot": "DotLiveView"}
    return t.sensors.join(first, "sensor_id").groupBy("zone_id").agg(*(F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()), F.round(F.count("*") / F.greatest(F.lit(0.16), F.lit(1e-9)), 6).alias("density"))


@query("agg_cell_mean", "SELECT CAST(FLOOR(x / 100.0e0) AS BIGINT) AS cx, CAST(FLOOR(y / 100.0e0) AS BIGINT) AS cy, ROUND(AVG(facility_id % 10 / 10.0e0), 6) AS score FROM v_facilities GROUP BY 1, 2")
def agg_cell_mean(t: Tables) -> DataFrame:
    return t.facilities.groupBy(spatial.cell("x", 100.0).alias("cx"), spatial.cell("y", 100.0).alias("cy")).agg(F.round(F.avg(F.expr("facility_id % 10 / 10.0e0")), 6).alias("score"))


@query("agg_building_mass", f"SELECT n.node_id, SUM(f.facility_id % 500 + 20.0e0) AS mass FROM v_nodes n JOIN ({SITES}) f ON (n.x - f.sx) ** 2 + (n.y - f.sy) ** 2 <= 14400.0e0 GROUP BY n.node_id")
def agg_building_mass(t: Tables) -> DataFrame:
    return spatial.within(t.nodes, sites(t), 120.0).groupBy("node_id").agg(F.sum(F.expr("facility_id % 500 + 20.0e0")).alias("mass"))


RUNS = "SELECT trip_id, MIN(time_min) AS s, MAX(time_min) AS e FROM v_keyframes GROUP BY trip_id"
ACTIVE = f"SELECT (CAST(FLOOR(s) AS BIGINT) + k) % 1440 AS minute, COUNT(*) AS active FROM ({RUNS}) r CROSS JOIN (SELECT UNNEST(RANGE(0, 60)) AS k) m WHERE k < GREATEST(CAST(CEIL(e) AS BIGINT), CAST(FLOOR(s) AS BIGINT) + 1) - CAST(FLOOR(s) AS BIGINT) GROUP BY 1"


def runs(t: Tables) -> DataFrame:
    return t.keyframes.groupBy("trip_id").agg(F.min("time_min").alias("s"), F.max("time_min").alias("e"))


def active_per_minute(spans: DataFrame) -> DataFrame:
    """(minute, active) of spans(s, e): the minutes that each touches, modulo a day."""
    first = F.floor("s").cast("long")
    minutes = F.explode(F.sequence(first, F.greatest(F.ceil("e").cast("long"), first + 1) - 1))
    return spans.select(minutes.alias("m")).groupBy(F.pmod("m", F.lit(1440)).alias("minute")).agg(F.count("*").alias("active"))


@query("agg_active_per_minute", ACTIVE)
def agg_active_per_minute(t: Tables) -> DataFrame:
    return active_per_minute(runs(t))


def headway_from_activity(active: DataFrame, minutes: DataFrame) -> DataFrame:
    """(minute, headway): 8 minutes times the mean of the busy minutes over the minute's activity, 3 to 60; 60 where idle."""
    mean = active.where("active > 0").agg(F.avg("active").alias("mean"))
    out = minutes.join(active, "minute", "left").crossJoin(F.broadcast(mean))
    return out.select("minute", F.when(F.coalesce("active", F.lit(0)) > 0, geo.clamp(8 * F.col("mean") / F.col("active"), 3.0, 60.0)).otherwise(60.0).alias("headway"))


@query("agg_headway_from_activity", f"SELECT m.minute, ROUND(CASE WHEN a.active > 0 THEN GREATEST(3.0e0, LEAST(60.0e0, 8 * (SELECT AVG(active) FROM ({ACTIVE}) z) / a.active)) ELSE 60.0e0 END, 6) AS headway FROM (SELECT CAST(UNNEST(RANGE(0, 1440)) AS BIGINT) AS minute) m LEFT JOIN ({ACTIVE}) a ON a.minute = m.minute")
def agg_headway_from_activity(t: Tables) -> DataFrame:
    minutes = t.spark.range(1440).withColumnRenamed("id", "minute")
    return headway_from_activity(active_per_minute(runs(t)), minutes).withColumn("headway", F.round("headway", 6))


@query("agg_volume_mult", "SELECT pu_min AS minute, ROUND(n * 1.0e0 / MAX(n) OVER (), 8) AS mult FROM (SELECT pu_min, COUNT(*) AS n FROM v_trips GROUP BY pu_min) q")
def agg_volume_mult(t: Tables) -> DataFrame:
    n = t.trip_rows.groupBy(F.col("pu_min").alias("minute")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("top")))).select("minute", F.round(F.col("n") / F.col("top"), 8).alias("mult"))


EVENTS = "SELECT minute, SUM(d) AS d FROM (SELECT pu_min AS minute, 1 AS d FROM v_trips UNION ALL SELECT pu_min + CAST(CEIL(dur_min) AS BIGINT), -1 FROM v_trips) e GROUP BY minute"
CONCURRENCY = f"SELECT minute, CAST(SUM(COALESCE(d, 0)) OVER (ORDER BY minute) AS BIGINT) AS active FROM (SELECT m.minute, e.d FROM (SELECT CAST(UNNEST(RANGE(0, 1440)) AS BIGINT) AS minute) m LEFT JOIN ({EVENTS}) e ON e.minute = m.minute) q"


def concurrency(trips: DataFrame) -> DataFrame:
    """(minute, active) for each minute of a day: starts and ends are counted by minute, then summed up over at most 1440 rows."""
    ends = F.explode(F.array(F.struct(F.col("pu_min").alias("minute"), F.lit(1).alias("d")), F.struct((F.col("pu_min") + F.ceil("dur_min").cast("long")).alias("minute"), F.lit(-1).alias("d"))))
    d = trips.select(ends.alias("e")).groupBy("e.minute").agg(F.sum("e.d").alias("d"))
    spine = trips.sparkSession.range(1440).withColumnRenamed("id", "minute")
    return spine.join(d, "minute", "left").select("minute", F.sum(F.coalesce("d", F.lit(0))).over(Window.orderBy("minute")).cast("long").alias("active"))


def concurrency_summary(c: DataFrame) -> DataFrame:
    c = graph.checkpointed(c)  # a row for each minute
    (median, p95), *_ = order.at_ranks(c, "active", lambda n: [math.floor(n * p) for p in (0.5, 0.95)])
    top = c.agg(F.max("active").alias("peak"), F.max_by("minute", F.struct("active", -F.col("minute"))).alias("peak_minute"), F.round(F.avg("active"), 6).alias("mean"), F.count_if(F.col("active") > 1000).alias("over_k"))
    return top.withColumns({"median": F.lit(median).cast("long"), "p95": F.lit(p95).cast("long")})


SUMMARY = f"""SELECT (SELECT MAX(active) FROM ({CONCURRENCY}) a) AS peak, (SELECT MIN(minute) FROM ({CONCURRENCY}) b WHERE active = (SELECT MAX(active) FROM ({CONCURRENCY}) a)) AS peak_minute,
  ROUND(AVG(active), 6) AS mean, COUNT(CASE WHEN active > 1000 THEN 1 END) AS over_k, MAX(CASE WHEN rn - 1 = 720 THEN active END) AS median, MAX(CASE WHEN rn - 1 = 1368 THEN active END) AS p95 FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY active) AS rn FROM ({CONCURRENCY}) c) q"""


@query("agg_concurrency_diff", SUMMARY)
def agg_concurrency_diff(t: Tables) -> DataFrame:
    return concurrency_summary(concurrency(t.trip_rows))


INCIDENCE = "SELECT trip_id AS route_id, (trip_id * 7 + k * 13) % 880 AS edge_id FROM v_trips CROSS JOIN (SELECT UNNEST(RANGE(0, 5)) AS k) n"


def incidence(t: Tables) -> DataFrame:
    """(route_id, edge_id): five edges for each trip."""
    return t.trips.select(F.col("trip_id").alias("route_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("route_id", F.expr("(route_id * 7 + k * 13) % 880").alias("edge_id"))


@query("agg_edge_traversals", f"SELECT CAST(edge_id AS BIGINT) AS edge_id, COUNT(*) AS traversals FROM ({INCIDENCE}) i GROUP BY 1")
def agg_edge_traversals(t: Tables) -> DataFrame:
    return incidence(t).groupBy("edge_id").agg(F.count("*").alias("traversals"))


SIZES = (1, 5, 10, 30, 100, 300, 1000, 3000)
POWER = f"SELECT s.size, ROUND(SUM(1 - POWER(1 - c * 1.0e0 / m, s.size)) / 880.0e0, 8) AS coverage FROM (SELECT edge_id, COUNT(*) AS c FROM ({INCIDENCE}) i GROUP BY edge_id) t CROSS JOIN (SELECT COUNT(*) AS m FROM v_trips) n CROSS JOIN (SELECT CAST(UNNEST([1, 5, 10, 30, 100, 300, 1000, 3000]) AS BIGINT) AS size) s GROUP BY s.size"


def sensing_power(counts: DataFrame, trips: int | Column, segments: int, sizes=SIZES) -> DataFrame:
    """(size, coverage) C(N) of counts(c, k): k segments that c of all trips traverse."""
    q = 1 - F.col("c") / (trips if isinstance(trips, Column) else F.lit(trips))
    rows = counts.select("*", F.explode(F.array(*(F.lit(n).cast("long") for n in sizes))).alias("size"))
    return rows.groupBy("size").agg((F.sum(F.col("k") * (1 - F.pow(q, F.col("size")))) / segments).alias("coverage"))


def traversal_histogram(t: Tables) -> DataFrame:
    """(c, k, m): how many edges have c traversals, and the number of trips."""
    c = incidence(t).groupBy("edge_id").agg(F.count("*").alias("c")).groupBy("c").agg(F.count("*").alias("k"))
    return c.crossJoin(F.broadcast(t.trip_rows.agg(F.count("*").alias("m"))))


@query("agg_sensing_power", POWER)
def agg_sensing_power(t: Tables) -> DataFrame:
    return sensing_power(traversal_histogram(t), F.col("m"), 880).withColumn("coverage", F.round("coverage", 8))


def solve_n(histogram: list[tuple[int, int]], trips: int, segments: int, target: float) -> float:
    """The N with coverage `target`: doubling, then 40 bisections, over a histogram of traversal counts."""
    cover = lambda n: sum(k * (1 - (1 - c / trips) ** n) for c, k in histogram) / segments
    high = 1.0
    while cover(high) < target and high < 1e9:
        high *= 2
    low = 0.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if cover(mid) < target else (low, mid)
    return high


#: 60 halvings of (0, 1e9): N is the share's root to far below the three digits that are kept.
SOLVE = f"""WITH RECURSIVE h AS (SELECT c * 1.0e0 / m AS q, COUNT(*) * 1.0e0 AS k FROM (SELECT edge_id, COUNT(*) AS c FROM ({INCIDENCE}) i GROUP BY edge_id) t CROSS JOIN (SELECT COUNT(*) AS m FROM v_trips) n GROUP BY 1),
  top AS (SELECT SUM(k) AS segments FROM h), goal AS (SELECT share, share * segments AS want FROM top CROSS JOIN (SELECT 1 / 3.0e0 AS share UNION ALL SELECT 1 / 2.0e0) s),
  step AS (SELECT share, want, 0.0e0 AS low, 1.0e9 AS high, 0 AS i FROM goal UNION ALL
    SELECT share, want, CASE WHEN got < want THEN mid ELSE low END, CASE WHEN got < want THEN high ELSE mid END, i + 1 FROM
    (SELECT s.share, s.want, s.low, s.high, s.i, (s.low + s.high) / 2 AS mid, SUM(h.k * (1 - POWER(1 - h.q, (s.low + s.high) / 2))) AS got FROM step s CROSS JOIN h WHERE s.i < 60 GROUP BY ALL) g)
  SELECT share, ROUND(high, 3) AS n FROM step WHERE i = 60"""


@query("agg_solve_n", SOLVE)
def agg_solve_n(t: Tables) -> DataFrame:
    h = traversal_histogram(t).collect()  # a row for each distinct count
    rows, trips = [(r["c"], r["k"]) for r in h], h[0]["m"] if h else 1
    top = sum(k for _, k in rows) / 880
    return t.spark.createDataFrame([(f, round(solve_n(rows, trips, 880, f * top), 3)) for f in (1 / 3, 1 / 2)], "share double, n double")


@query("agg_institution_type_avg", f"SELECT fkind AS kind, ROUND(AVG(n), 6) AS mean FROM (SELECT f.facility_id, f.fkind, COUNT(s.sensor_id) AS n FROM ({SITES}) f LEFT JOIN v_sensors s ON (s.x - f.sx) ** 2 + (s.y - f.sy) ** 2 <= 40000.0e0 GROUP BY 1, 2) q GROUP BY fkind")
def agg_institution_type_avg(t: Tables) -> DataFrame:
    """Sensors are counted by place, and the counts summed up once for each place of facilities."""
    seen = t.sensors.groupBy("x", "y").agg(F.count("*").alias("c"))
    at = sites(t).select("sx", "sy").distinct()
    n = spatial.within(seen, at, 200.0).groupBy(F.col("sx").alias("x"), F.col("sy").alias("y")).agg(F.sum("c").alias("n"))
    return t.facilities.join(n, ["x", "y"], "left").groupBy("kind").agg(F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("mean")).orderBy(F.desc("mean"), "kind")


@query("agg_edge_class_coverage", f"SELECT COUNT(*) AS total, COUNT(c.edge_id) AS covered FROM v_edges e LEFT JOIN (SELECT DISTINCT edge_id FROM ({INCIDENCE}) i) c ON c.edge_id = e.edge_id WHERE e.edge_id % 14 = 2")
def agg_edge_class_coverage(t: Tables) -> DataFrame:
    c = incidence(t).select("edge_id", F.lit(True).alias("hit")).distinct()
    return t.edges.where("edge_id % 14 = 2").join(c, "edge_id", "left").agg(F.count("*").alias("total"), F.count("hit").alias("covered"))


@query("agg_cell_set", "SELECT cx, cy, STRING_AGG(CAST(edge_id AS VARCHAR), ',' ORDER BY edge_id) AS edges FROM (SELECT DISTINCT edge_id, CAST(FLOOR((x0 + (x1 - x0) * k / n) / 60.0e0) AS BIGINT) AS cx, CAST(FLOOR((y0 + (y1 - y0) * k / n) / 60.0e0) AS BIGINT) AS cy FROM (SELECT *, 3.0e0 AS n FROM v_edges) e CROSS JOIN (SELECT UNNEST(RANGE(0, 4)) AS k) s) q GROUP BY cx, cy")
def agg_cell_set(t: Tables) -> DataFrame:
    from kerbside.operators.geometry import rasterized

    cells = rasterized(t.edges, "edge_id", 60.0)
    return cells.groupBy("cx", "cy").agg(F.array_join(F.array_sort(F.collect_set("edge_id")).cast("array<string>"), ",").alias("edges"))


@query("agg_argmax", f"SELECT MIN(minute) AS minute FROM ({CONCURRENCY}) c WHERE active = (SELECT MAX(active) FROM ({CONCURRENCY}) d)")
def agg_argmax(t: Tables) -> DataFrame:
    return concurrency(t.trip_rows).agg(F.max_by("minute", F.struct("active", -F.col("minute"))).alias("minute"))


@query("agg_first_seen", f"SELECT edge_id, grp, sensor_id, kind FROM (SELECT edge_id, {GRP} AS grp, sensor_id, kind, ROW_NUMBER() OVER (PARTITION BY edge_id, {GRP} ORDER BY tick, sensor_id) AS rn FROM ({CAPTURED}) c) q WHERE rn = 1")
def agg_first_seen(t: Tables) -> DataFrame:
    seen = captured(t).withColumn("grp", F.expr(GRP)).groupBy("edge_id", "grp").agg(F.min(F.struct("tick", "sensor_id", "kind")).alias("b"))
    return seen.select("edge_id", "grp", "b.sensor_id", "b.kind")


PRIORITY = "CASE kind WHEN 'Alpr' THEN 0 WHEN 'FixedCctv' THEN 1 WHEN 'DotLiveView' THEN 2 ELSE 3 END"


@query("agg_primary_member", f"SELECT CAST({GRP} AS BIGINT) AS grp, ARG_MIN(sensor_id, ({PRIORITY}) * 100000000 + sensor_id) AS sensor_id FROM v_sensors GROUP BY 1")
def agg_primary_member(t: Tables) -> DataFrame:
    return t.sensors.groupBy(F.expr(GRP).cast("long").alias("grp")).agg(F.min_by("sensor_id", F.struct(F.expr(PRIORITY), "sensor_id")).alias("sensor_id"))


@query("agg_operator_columns", f"SELECT d.label, COUNT(*) AS devices FROM v_sensors s JOIN ({DIM}) d ON d.kind = s.kind GROUP BY d.label")
def agg_operator_columns(t: Tables) -> DataFrame:
    n = t.sensors.groupBy("kind").agg(F.count("*").alias("devices"))
    return n.join(F.broadcast(scalar.source_dim(t.spark)), "kind").select("label", "devices").orderBy(F.desc("devices"), "label")
