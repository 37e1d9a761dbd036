"""Composite queries: the answers that a user asks for."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import geo, scalar
from kerbside.operators import exposure, fleet, geometry, graph, sequence, spatial, timetable
from kerbside.sources import readers

from . import aggregates as ag
from .joins import CC, EDGE_T, PIP, RING_EDGES, SITES, clusters, sites
from .registry import query
from .scalars import COVERED, WALL_CROSS, WALLS, curve_sql
from .sequences import PACE, STRETCH, replicated
from .sources import documents, place
from .views import Tables

HOUR = 17.0
GROUPED = f"""(SELECT v.*, c.component AS grp, BOOL_OR(v.kind <> 'FixedCctv') OVER (PARTITION BY c.component) AS confirmed
  FROM v_sensors v JOIN ({CC}) c ON c.node_id = v.sensor_id)"""
MID = "SELECT edge_id, x1 AS px, y1 AS py FROM v_edges"
CORRIDOR_STEP_M = 10.0
CORRIDOR = f"""(SELECT DISTINCT x0 + (x1 - x0) * (k / n) AS x, y0 + (y1 - y0) * (k / n) AS y FROM
  (SELECT *, GREATEST(1.0e0, CEIL(SQRT((x1 - x0) ** 2 + (y1 - y0) ** 2) / 10.0e0)) AS n FROM ({STRETCH}) s WHERE a1 IS NOT NULL) s JOIN (SELECT CAST(UNNEST(RANGE(0, 100)) AS DOUBLE) AS k) i ON k <= n)"""


def own_groups(t: Tables) -> DataFrame:
    """Sensors as wedges, each a group of its own."""
    return spatial.placed(t.sensors).withColumns({"grp": F.col("sensor_id"), "confirmed": F.col("kind") != "FixedCctv"})


def devices(t: Tables) -> DataFrame:
    """Sensors as wedges, grouped: those of different kinds within 15 m are one device, confirmed if any of it was surveyed."""
    return spatial.placed(exposure.grouped(t.sensors, clusters(t)))


def devices_by_place(t: Tables) -> DataFrame:
    """Devices, one row for sensors that differ in their ids alone: the smallest id stands for `copies` of them."""
    d = devices(t)
    return d.groupBy(*(c for c in d.columns if c != "sensor_id")).agg(F.min("sensor_id").alias("sensor_id"), F.count("*").alias("copies"))


def walks(t: Tables) -> DataFrame:
    """(route_id, walk): routes along the same points are one walk, named by the smallest of them."""
    lines = geometry.rings(t.route_points, "route_id", "seq").select("route_id", F.col("ring").alias("points"))
    return lines.join(lines.groupBy("points").agg(F.min("route_id").alias("walk")), "points").select("route_id", "walk")


def walked(t: Tables, walk: DataFrame) -> DataFrame:
    """The ticks of each walk once; route_id is the walk."""
    return exposure.walk_ticks(t.route_points.join(walk.where("route_id = walk").select("route_id"), "route_id", "left_semi"), "route_id")


def of_routes(found: DataFrame, walk: DataFrame) -> DataFrame:
    """What was found for each walk, for all its routes."""
    return walk.join(found.withColumnRenamed("route_id", "walk"), "walk").drop("walk")


def corridor(t: Tables) -> DataFrame:
    """Points at most ten metres apart along each corridor, so that no middle of a long segment is missed; a place that several
    share occurs once."""
    stretches = sequence.segments(t.route_points, "route_id").select("x0", "y0", "x1", "y1").distinct()
    return geometry.densified(stretches, CORRIDOR_STEP_M).select(F.col("x").alias("sx"), F.col("y").alias("sy")).distinct()


def zones(t: Tables) -> DataFrame:
    return t.zone_rings.withColumn("intensity", F.expr("1.0e0 + zone_id % 7 / 2.0e0"))


def _rates_sql(h: str, near: str, zone: str) -> str:
    c = lambda f, a, p: curve_sql(h, f, a, p)
    head = f"CASE WHEN ({h} >= 7 AND {h} < 9) OR ({h} >= 16 AND {h} < 19) THEN 5.0e0 WHEN {h} >= 6 AND {h} < 22 THEN 10.0e0 ELSE 25.0e0 END"
    return f"""CASE WHEN {near} THEN 120.0e0 / (60 * {head}) ELSE 0.0e0 END AS ace, 12.0e0 * {c(0.12, 8.5, 17.5)} * {zone} * 0.16e0 AS dashcam,
  60.0e0 * {c(0.1, 9.0, 18.0)} * 0.0002e0 AS glasses, 2.0e0 * {c(0.05, 12.0, 18.5)} * 0.3e0 * 0.5e0 AS robots, 1.2e0 AS tesla"""


def _heat_sql(points: str, key: str) -> str:
    names = ("fixed", "ace", "dashcam", "glasses", "robots", "tesla")
    return f"""SELECT {key}, {', '.join(f'ROUND({n}, 6) AS {n}' for n in names)} FROM (SELECT p.{key}, COALESCE(f.fixed, 0.0e0) AS fixed, {_rates_sql('17.0e0', 'n.near IS NOT NULL', 'COALESCE(z.zone, 1.0e0)')} FROM ({points}) p
  LEFT JOIN (SELECT {key}, SUM(CASE WHEN kind <> 'FixedCctv' THEN 1.0e0 ELSE 1.0e0 / 0.63e0 END) AS fixed FROM (SELECT * FROM ({points}) t JOIN v_sensors s ON ABS(t.px - s.x) <= 30 AND ABS(t.py - s.y) <= 30) q WHERE {COVERED} GROUP BY {key}) f ON f.{key} = p.{key}
  LEFT JOIN (SELECT DISTINCT {key}, TRUE AS near FROM ({points}) t JOIN {CORRIDOR} r ON (t.px - r.x) ** 2 + (t.py - r.y) ** 2 <= 400.0e0) n ON n.{key} = p.{key}
  LEFT JOIN (SELECT {key}, MIN(zone_id) % 7 / 2.0e0 + 1.0e0 AS zone FROM ({PIP.replace('v_sensors s', f'({points}) s').replace('s.sensor_id, s.kind', f's.{key}').replace('s.x', 's.px').replace('s.y', 's.py')}) w GROUP BY {key}) z ON z.{key} = p.{key}) o"""


@query("q_edge_heatmap", _heat_sql(MID, "edge_id"))
def q_edge_heatmap(t: Tables) -> DataFrame:
    """Captures per minute of each class at each edge's midpoint, the second end of a two-point edge."""
    out = exposure.heatmap(t.sql(MID), "edge_id", own_groups(t), corridor(t), zones(t), HOUR, 30.0, 200.0)
    return out.select("edge_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


HEAT_CLASSES = ("fixed", "ace", "dashcam", "glasses", "robots", "tesla")
#: Metres of a cell and around the streets, least and most columns and rows.
HEAT_CELL_M, HEAT_PAD_M, HEAT_COLUMNS, HEAT_ROWS = 45.0, 60.0, (48, 280), (48, 360)
GRID = """SELECT i + j * gw AS cell_id, minx + (i + 0.5e0) * (w / gw) AS px, miny + (j + 0.5e0) * (h / gh) AS py, 20.0e0 + GREATEST(w / gw, h / gh) AS wide
  FROM (SELECT *, GREATEST(48, LEAST(280, CAST(ROUND(w / 45.0e0) AS BIGINT))) AS gw, GREATEST(48, LEAST(360, CAST(ROUND(h / 45.0e0) AS BIGINT))) AS gh
    FROM (SELECT MIN(x) - 60 AS minx, MIN(y) - 60 AS miny, MAX(x) - MIN(x) + 120 AS w, MAX(y) - MIN(y) + 120 AS h FROM v_nodes) e) g
  JOIN (SELECT CAST(UNNEST(RANGE(0, 280)) AS BIGINT) AS i) a ON i < gw JOIN (SELECT CAST(UNNEST(RANGE(0, 360)) AS BIGINT) AS j) b ON j < gh"""


@query("q_grid_heatmap", f"""SELECT cell_id, ROUND(total / MAX(total) OVER (), 6) AS heat FROM
  (SELECT cell_id, {' + '.join(HEAT_CLASSES)} AS total FROM ({_heat_sql(GRID, 'cell_id').replace('<= 400.0e0', '<= t.wide ** 2')}) h) q""")
def q_grid_heatmap(t: Tables) -> DataFrame:
    return grid_heat(t)


def grid_heat(t: Tables, chosen: str = "total") -> DataFrame:
    """(cell_id, heat): one class or the total in cells over the extent of the streets, against the hottest cell.

    Cells are of about 45 m, but 48 to 280 by 48 to 360 of them, whatever the extent; a corridor is near if it comes within
    its reach and a cell's longer side."""
    e = t.nodes.agg(*(f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max)))).first()
    if e.minx is None:
        return t.spark.createDataFrame([], "cell_id long, heat double")
    (w, gw), (h, gh) = ((most - least + 2 * HEAT_PAD_M, min(max(round((most - least + 2 * HEAT_PAD_M) / HEAT_CELL_M), low), high)) for least, most, (low, high) in ((e.minx, e.maxx, HEAT_COLUMNS), (e.miny, e.maxy, HEAT_ROWS)))
    at = lambda least, i, side, n: least - HEAT_PAD_M + (i + 0.5) * (side / n)
    grid = t.spark.range(gw * gh).select(F.col("id").alias("cell_id"), at(e.minx, F.col("id") % gw, w, gw).alias("px"), at(e.miny, F.floor(F.col("id") / gw), h, gh).alias("py"))
    rates = exposure.heatmap(grid, "cell_id", own_groups(t), corridor(t), zones(t), HOUR, 30.0, 200.0, exposure.ACE_REACH_M + max(w / gw, h / gh))
    parts = [F.round(c, 6) for c in (HEAT_CLASSES if chosen == "total" else (chosen,))]
    heat = rates.select("cell_id", sum(parts[1:], parts[0]).alias("value"))
    top = F.broadcast(heat.agg(F.max("value").alias("top")))
    return heat.crossJoin(top).select("cell_id", F.when(F.col("top") > 0, F.round(F.col("value") / F.col("top"), 6)).otherwise(0.0).alias("heat"))


WALK = f"SELECT route_id, CAST(k AS BIGINT) AS tick, LEAST(k * 1.0e0, d) AS t, CASE WHEN k < CEIL(d) THEN 1.0e0 ELSE d - (CEIL(d) - 1) END AS weight, x0 + (x1 - x0) * (a - a0) / (a1 - a0) AS px, y0 + (y1 - y0) * (a - a0) / (a1 - a0) AS py FROM (SELECT s.*, k, total / 1.34e0 AS d, LEAST(LEAST(k * 1.0e0, total / 1.34e0) * 1.34e0, total) AS a FROM ({STRETCH}) s CROSS JOIN (SELECT UNNEST(RANGE(0, 400)) AS k) n WHERE a1 IS NOT NULL AND k <= CEIL(total / 1.34e0)) q WHERE a >= a0 AND (a < a1 OR (a1 = total AND a <= a1))"
ROBOT_CELLS = "SELECT CAST(FLOOR(x / 100.0e0) AS BIGINT) AS cx, CAST(FLOOR(y / 100.0e0) AS BIGINT) AS cy, AVG(facility_id % 10 / 10.0e0) AS score FROM v_facilities GROUP BY 1, 2"
DAY = f"""SELECT m.minute, CASE WHEN a.active > 0 THEN GREATEST(3.0e0, LEAST(60.0e0, 8 * (SELECT AVG(active) FROM ({ag.ACTIVE}) z) / a.active)) ELSE 60.0e0 END AS headway,
  COALESCE(v.n, 0) * 1.0e0 / (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM v_trips GROUP BY pu_min) x) AS traffic FROM (SELECT CAST(UNNEST(RANGE(0, 1440)) AS BIGINT) AS minute) m
  LEFT JOIN ({ag.ACTIVE}) a ON a.minute = m.minute LEFT JOIN (SELECT pu_min, COUNT(*) AS n FROM v_trips GROUP BY pu_min) v ON v.pu_min = m.minute"""
WALK_ZONE = f"""SELECT route_id, tick, MIN(zone_id) AS zone_id FROM (SELECT s.route_id, s.tick, e.zone_id FROM (SELECT route_id, tick, px AS x, py AS y FROM ({WALK}) w) s
  JOIN ({RING_EDGES}) e ON (e.y1 > s.y) <> (e.y0 > s.y) AND s.x < (e.x0 - e.x1) * (s.y - e.y1) / (e.y0 - e.y1) + e.x1 GROUP BY s.route_id, s.tick, e.zone_id HAVING COUNT(*) % 2 = 1) q GROUP BY route_id, tick"""


def day(t: Tables) -> DataFrame:
    """(minute, headway, traffic) of the day that the tables hold: bus headways from trips under way, traffic from pickups."""
    minutes = t.spark.range(1440).withColumnRenamed("id", "minute")
    n = t.trip_rows.groupBy(F.col("pu_min").alias("minute")).agg(F.count("*").alias("n"))
    volume = minutes.join(n, "minute", "left").crossJoin(F.broadcast(n.agg(F.max("n").alias("top")))).select("minute", (F.coalesce("n", F.lit(0)) / F.col("top")).alias("traffic"))
    return ag.headway_from_activity(ag.active_per_minute(ag.runs(t)), minutes).join(volume, "minute")


MOBILE = f"""SELECT route_id, ROUND(SUM(CASE WHEN near THEN 120.0e0 / GREATEST(60 * headway, 1.0e0) ELSE 0.0e0 END / 60 * weight), 6) AS ace, ROUND(SUM(12.0e0 * traffic * dashcam * 0.16e0 / 60 * weight), 6) AS dashcam,
  ROUND(SUM(60.0e0 * {curve_sql('hour', 0.1, 9.0, 18.0)} * 0.0002e0 / 60 * weight), 6) AS glasses, ROUND(SUM(2.0e0 * {curve_sql('hour', 0.05, 12.0, 18.5)} * score * 0.5e0 / 60 * weight), 6) AS robots, ROUND(SUM(1.2e0 * tesla / 60 * weight), 6) AS tesla FROM
  (SELECT w.*, n.near IS NOT NULL AS near, d.headway, d.traffic, COALESCE(1.0e0 + z.zone_id % 7 / 2.0e0, 1.0e0) AS dashcam, COALESCE(z.zone_id % 5 / 4.0e0, 0.1e0) AS tesla, COALESCE(c.score, 0.1e0) AS score
   FROM (SELECT *, 8.0e0 + t / 3600 AS hour FROM ({WALK}) w) w
   LEFT JOIN (SELECT DISTINCT w.route_id, w.tick, TRUE AS near FROM ({WALK}) w JOIN {CORRIDOR} r ON (w.px - r.x) ** 2 + (w.py - r.y) ** 2 <= 400.0e0) n ON n.route_id = w.route_id AND n.tick = w.tick
   LEFT JOIN ({WALK_ZONE}) z ON z.route_id = w.route_id AND z.tick = w.tick
   LEFT JOIN ({ROBOT_CELLS}) c ON c.cx = CAST(FLOOR(w.px / 100.0e0) AS BIGINT) AND c.cy = CAST(FLOOR(w.py / 100.0e0) AS BIGINT)
   JOIN ({DAY}) d ON d.minute = CAST(FLOOR(w.hour * 60) AS BIGINT)) q GROUP BY route_id"""


@query("q_mobile_integral", MOBILE)
def q_mobile_integral(t: Tables) -> DataFrame:
    """The five mobile integrals of every walk, with all fields and the real day's curves."""
    walk = graph.checkpointed(walks(t))
    out = mobile(t, walked(t, walk))
    return of_routes(out.select("route_id", *(F.round(c, 6).alias(c) for c in out.columns[1:])), walk)


def mobile(t: Tables, ticks: DataFrame) -> DataFrame:
    zones_ = t.zone_rings.withColumns({"dashcam": F.expr("1.0e0 + zone_id % 7 / 2.0e0"), "tesla": F.expr("zone_id % 5 / 4.0e0")})
    return exposure.mobile_integral(ticks, "route_id", 8.0, corridor(t), exposure.Fields(zones_, 200.0, t.sql(ROBOT_CELLS), 100.0, day(t)))


CLASSES = ("ace", "dashcam", "glasses", "robots", "tesla")
SEEN = f"SELECT * FROM (SELECT w.*, s.* FROM ({WALK}) w JOIN {GROUPED} s ON ABS(w.px - s.x) <= 30 AND ABS(w.py - s.y) <= 30) q WHERE {COVERED} AND NOT EXISTS (SELECT 1 FROM ({WALLS}) o WHERE {WALL_CROSS})"


@query("q_route_exposure", f"""SELECT route_id, kind, CAST(COUNT(DISTINCT sensor_id) AS DOUBLE) AS expected, ROUND(SUM(frame_rate * weight), 3) AS frames, 1.0e0 AS p FROM ({SEEN}) s GROUP BY route_id, kind
UNION ALL SELECT d.route_id, 'fixed', ROUND(g.grouped, 6), ROUND(d.frames, 3), 1.0e0 FROM (SELECT route_id, SUM(frame_rate * weight) AS frames FROM ({SEEN}) s GROUP BY route_id) d
  JOIN (SELECT route_id, SUM(CASE WHEN confirmed THEN 1.0e0 ELSE 1.0e0 / 0.63e0 END) AS grouped FROM (SELECT DISTINCT route_id, grp, confirmed FROM ({SEEN}) s) q GROUP BY route_id) g ON g.route_id = d.route_id
UNION ALL SELECT route_id, kind, expected, NULL, ROUND(1 - EXP(-expected), 6) FROM (SELECT route_id, kind, CASE kind {' '.join(f"WHEN '{c}' THEN {c}" for c in CLASSES)} END AS expected FROM ({MOBILE}) m JOIN (SELECT UNNEST([{', '.join(f"'{c}'" for c in CLASSES)}]) AS kind) k ON TRUE) e""")
def q_route_exposure(t: Tables) -> DataFrame:
    """The exposure of every walk: fixed cameras by kind that no wall hides, all of them as devices corrected for recall
    (`fixed`), and the five mobile classes with the probability of one capture at least."""
    walk = graph.checkpointed(walks(t))
    ticks = walked(t, walk)
    walls = t.sql(WALLS).select("wx0", "wy0", "wx1", "wy1").distinct()
    seen = graph.checkpointed(spatial.unblocked(spatial.captures(ticks, devices_by_place(t), 30.0), walls, 60.0, ("route_id", "tick", "sensor_id")))
    by_kind = exposure.tally(seen, ["route_id", "kind"]).select("route_id", "kind", F.col("devices").cast("double").alias("expected"), F.round("frames", 3).alias("frames"), F.lit(1.0).alias("p"))
    fixed = exposure.tally(seen, ["route_id"]).select("route_id", F.lit("fixed").alias("kind"), F.round("grouped", 6).alias("expected"), F.round("frames", 3).alias("frames"), F.lit(1.0).alias("p"))
    moving = mobile(t, ticks).select("route_id", F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.round(c, 6).alias("expected")) for c in CLASSES))).alias("m")).select("route_id", "m.*")
    found = by_kind.unionByName(fixed).unionByName(moving.withColumns({"frames": F.lit(None).cast("double"), "p": F.round(1 - F.exp(-F.col("expected")), 6)}))
    return of_routes(found, walk)


HOPS = """WITH RECURSIVE adj AS (SELECT from_id AS a, to_id AS b FROM v_edges UNION ALL SELECT to_id, from_id FROM v_edges),
  hop AS (SELECT CAST(220 AS BIGINT) AS node_id, 0 AS d UNION SELECT b, d + 1 FROM hop JOIN adj ON a = node_id WHERE d < 4), reached AS (SELECT DISTINCT node_id FROM hop)"""


@query("q_walkshed_exposure", f"""{HOPS} SELECT COUNT(DISTINCT grp) AS raw, ROUND(SUM(CASE WHEN confirmed THEN 1.0e0 ELSE 1.0e0 / 0.63e0 END), 6) AS corrected FROM (SELECT DISTINCT grp, confirmed FROM
  (SELECT * FROM (SELECT x0 AS px, y0 AS py FROM v_edges WHERE from_id IN (SELECT node_id FROM reached) AND to_id IN (SELECT node_id FROM reached) UNION SELECT x1, y1 FROM v_edges WHERE from_id IN (SELECT node_id FROM reached) AND to_id IN (SELECT node_id FROM reached)) p JOIN {GROUPED} s ON ABS(p.px - s.x) <= 30 AND ABS(p.py - s.y) <= 30) q WHERE {COVERED}) d""")
def q_walkshed_exposure(t: Tables) -> DataFrame:
    """Groups that cover an end of an edge within 400 m of node 220; the edges here have two vertices, so the middle one is the last."""
    start = t.spark.sql("SELECT 0L AS source, 220L AS node_id")
    kept = t.edges.join(graph.isochrone_edges(t.edges, graph.reach(t.edges, start, 400.0)), "edge_id")
    ends = kept.select(F.explode(F.array(F.struct(F.col("x0").alias("px"), F.col("y0").alias("py")), F.struct(F.col("x1").alias("px"), F.col("y1").alias("py")))).alias("p")).select("p.*").distinct()
    seen = spatial.captures(ends, devices(t), 30.0, few=True).select("grp", "confirmed").distinct()
    return seen.agg(F.count("*").alias("raw"), F.round(F.sum(F.when(F.col("confirmed"), 1.0).otherwise(1 / exposure.RECALL)), 6).alias("corrected"))


EQUITY = f"SELECT e.geoid, e.entropy, COALESCE(c.n, 0) AS cameras FROM ({ag.ENTROPY}) e LEFT JOIN (SELECT zone_id, COUNT(*) AS n FROM ({PIP}) p GROUP BY zone_id) c ON c.zone_id = e.geoid"


@query("q_equity", f"SELECT geoid, entropy, cameras, ROUND(CORR(entropy, cameras) OVER (), 6) AS r FROM ({EQUITY}) q")
def q_equity(t: Tables) -> DataFrame:
    n = spatial.in_polygons(t.sensors, t.zone_rings, 200.0).groupBy(F.col("zone_id").alias("geoid")).agg(F.count("*").alias("n"))
    rows = ag.entropy(t.groups).join(n, "geoid", "left").select("geoid", (F.round("entropy", 6) + 0.0).alias("entropy"), F.coalesce("n", F.lit(0)).alias("cameras"))
    return rows.crossJoin(F.broadcast(rows.agg(F.round(ag.pearson("entropy", "cameras"), 6).alias("r"))))


MINUTES = (480, 720, 1020)
#: Each trip's route, and trips under way at each of the minutes with the share of their time.
TRIP_ROUTE = "SELECT t.*, CAST(low + (trip_id * 7919) % n AS BIGINT) AS route_id FROM v_trips t CROSS JOIN (SELECT MIN(s_suppkey) AS low, COUNT(*) AS n FROM supplier) s"
UNDER_WAY = f"SELECT trip_id, now, route_id, (now - pu_min) / dur_min AS f FROM ({TRIP_ROUTE}) t JOIN (SELECT UNNEST([{', '.join(map(str, MINUTES))}]) AS now) i ON pu_min <= now AND now < pu_min + dur_min"
REACHED = f"""SELECT u.trip_id, u.now, u.route_id, p.cum + (p.c1 - p.cum) * (u.f - p.raw) / (p.r1 - p.raw) AS arc FROM ({UNDER_WAY}) u
  JOIN (SELECT *, LEAD(raw) OVER (PARTITION BY route_id ORDER BY seq) AS r1, LEAD(cum) OVER (PARTITION BY route_id ORDER BY seq) AS c1 FROM ({PACE}) p) p ON p.route_id = u.route_id AND u.f >= p.raw AND u.f < p.r1"""
FLEET = f"SELECT trip_id, now, x0 + (x1 - x0) * (arc - a0) / (a1 - a0) AS x, y0 + (y1 - y0) * (arc - a0) / (a1 - a0) AS y FROM ({REACHED}) r JOIN ({STRETCH}) s ON s.route_id = r.route_id WHERE a1 IS NOT NULL AND arc >= a0 AND (arc < a1 OR (a1 = total AND arc <= a1))"
FLEET_ZONE = f"""SELECT now, trip_id, MIN(zone_id) AS zone_id FROM (SELECT s.now, s.trip_id, e.zone_id FROM ({FLEET}) s JOIN ({RING_EDGES}) e ON (e.y1 > s.y) <> (e.y0 > s.y) AND s.x < (e.x0 - e.x1) * (s.y - e.y1) / (e.y0 - e.y1) + e.x1
  GROUP BY s.now, s.trip_id, e.zone_id HAVING COUNT(*) % 2 = 1) q GROUP BY now, trip_id"""
LIVE = f"""SELECT i.now, z.zone_id, COALESCE(m.n, 0) AS vehicles, COALESCE(f.n, 0) + COALESCE(m.n, 0) * 0.1e0 AS density FROM v_zones z CROSS JOIN (SELECT UNNEST([{', '.join(map(str, MINUTES))}]) AS now) i
  LEFT JOIN (SELECT zone_id, COUNT(*) AS n FROM ({PIP}) p GROUP BY zone_id) f ON f.zone_id = z.zone_id LEFT JOIN (SELECT now, zone_id, COUNT(*) AS n FROM ({FLEET_ZONE}) v GROUP BY now, zone_id) m ON m.zone_id = z.zone_id AND m.now = i.now"""


@query("q_neighborhood_live", f"""SELECT CAST(l.now AS BIGINT) AS minute, zone_id, vehicles, ROUND(density, 6) AS density, ROUND(GREATEST(0.0e0, LEAST(1.0e0, (density - lo) / GREATEST(hi - lo, 1.0e-9))), 6) AS shade FROM ({LIVE}) l
  JOIN (SELECT now, MAX(CASE WHEN rn = 2 THEN density END) AS lo, MAX(CASE WHEN rn = 24 THEN density END) AS hi FROM (SELECT now, density, ROW_NUMBER() OVER (PARTITION BY now ORDER BY density) AS rn FROM ({LIVE}) l) w GROUP BY now) b ON b.now = l.now""")
def q_neighborhood_live(t: Tables) -> DataFrame:
    """Cameras and vehicles in each neighbourhood at several minutes: vehicles where they are on their routes then, in the first
    polygon that holds them."""
    instants = t.spark.range(1).select(F.explode(F.array(*map(F.lit, MINUTES))).alias("now"))
    fixed = spatial.in_polygons(t.sensors, t.zone_rings, 200.0).groupBy("zone_id").agg(F.count("*").alias("f"))
    vehicles = fleet.positions(t.sql(TRIP_ROUTE), instants, t.route_points, "route_id", "pu_min", "dur_min")
    held = spatial.first_polygon(vehicles.select(F.struct("now", "trip_id").alias("vehicle"), "x", "y"), t.zone_rings, "vehicle", "zone_id", 200.0)
    live = held.groupBy(F.col("vehicle.now").alias("now"), "zone_id").agg(F.count("*").alias("vehicles"))
    d = t.zones.select("zone_id").crossJoin(F.broadcast(instants)).join(fixed, "zone_id", "left").join(live, ["now", "zone_id"], "left")
    d = d.select("now", "zone_id", F.coalesce("vehicles", F.lit(0)).alias("vehicles"), (F.coalesce("f", F.lit(0)) + F.coalesce("vehicles", F.lit(0)) * 0.1).alias("density"))
    h = ag.ranked(d, "density", ["now"])
    ends = [ag.at_rank(h, "density", F.floor((F.col("n") - 1) * p + 0.5), ["now"]).withColumnRenamed("density", name) for p, name in ((0.05, "lo"), (0.95, "hi"))]
    shade = geo.clamp((F.col("density") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)), 0.0, 1.0)
    return d.join(ends[0], "now").join(ends[1], "now").select(F.col("now").cast("long").alias("minute"), "zone_id", "vehicles", F.round("density", 6).alias("density"), F.round(shade, 6).alias("shade"))


@query("q_institutions", f"SELECT facility_id, cameras, CAST(ROW_NUMBER() OVER (ORDER BY cameras DESC, name, facility_id) AS BIGINT) AS rank FROM (SELECT f.facility_id, f.name, COUNT(DISTINCT s.component) AS cameras FROM ({SITES}) f LEFT JOIN (SELECT v.x, v.y, c.component FROM v_sensors v JOIN ({CC}) c ON c.node_id = v.sensor_id) s ON (s.x - f.sx) ** 2 + (s.y - f.sy) ** 2 <= 40000.0e0 GROUP BY 1, 2) q")
def q_institutions(t: Tables) -> DataFrame:
    """Every institution, ranked by the groups (sensors of different kinds within 15 m are one device) that have a member
    within 200 m; those with none come last. Ranks are two-level: within the parts
    of a range-partitioned sort, which is written first so that parts stay as they are, and over the parts' counts."""
    # groups and facilities by place; a group that lies at one place only is counted there
    grp = t.sensors.join(clusters(t).withColumnsRenamed({"node_id": "sensor_id", "component": "grp"}), "sensor_id").select("grp", "x", "y").distinct()
    grp = graph.checkpointed(grp.join(grp.groupBy("grp").agg(F.count("*").alias("places")), "grp"))
    rows = grp.groupBy("x", "y", F.when(F.col("places") > 1, F.col("grp")).alias("grp")).agg(F.count("*").alias("c"))
    near = spatial.within(rows, sites(t).select("sx", "sy").distinct(), 200.0)
    once = near.groupBy("sx", "sy", "grp").agg(F.sum("c").alias("c"))
    n = once.groupBy("sx", "sy").agg(F.sum(F.when(F.col("grp").isNull(), F.col("c")).otherwise(1)).alias("n"))
    all_ = sites(t).select("facility_id", "name", "sx", "sy").join(n, ["sx", "sy"], "left").withColumn("cameras", F.coalesce("n", F.lit(0)))
    at = graph.checkpointed(all_.orderBy(F.desc("cameras"), "name", "facility_id").select("facility_id", "cameras", F.monotonically_increasing_id().alias("at")))
    at = at.select("facility_id", "cameras", F.shiftright("at", 33).alias("part"), F.expr("at & 8589934591").alias("inside"))
    parts = at.groupBy("part").agg(F.count("*").alias("n"))  # a row for each part
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return at.join(F.broadcast(before), "part").select("facility_id", "cameras", (F.col("before") + F.col("inside") + 1).alias("rank"))


@query("q_cctv_merge", "SELECT COUNT(*) AS cameras, SUM(CASE WHEN src = 0 THEN 1 ELSE 0 END)::BIGINT AS census FROM (SELECT 0 AS src FROM v_nodes CROSS JOIN (SELECT UNNEST(RANGE(1, 5)) AS k) n WHERE k <= CAST(ROUND((node_id % 9) / 2.0e0) AS BIGINT) UNION ALL SELECT 1 FROM v_sensors s WHERE NOT EXISTS (SELECT 1 FROM v_nodes n WHERE node_id % 9 > 0 AND (s.x - n.x) ** 2 + (s.y - n.y) ** 2 <= 2500.0e0)) q")
def q_cctv_merge(t: Tables) -> DataFrame:
    census = replicated(t.nodes, F.expr("(node_id % 9) / 2.0e0")).select(F.lit(0).alias("src"))
    base = t.nodes.where("node_id % 9 > 0").select(F.col("x").alias("sx"), F.col("y").alias("sy"))
    return census.union(spatial.beyond(t.sensors, base, 50.0).select(F.lit(1))).agg(F.count("*").alias("cameras"), F.count_if(F.col("src") == 0).alias("census"))


PAIRS2 = "SELECT a.sensor_id, b.kind FROM v_sensors a JOIN v_sensors b ON a.kind <> b.kind AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 225.0e0"


@query("q_cross_attestation", f"SELECT sensor_id, STRING_AGG(kind, ',' ORDER BY kind) AS kinds FROM (SELECT DISTINCT sensor_id, kind FROM ({PAIRS2}) p) q GROUP BY sensor_id")
def q_cross_attestation(t: Tables) -> DataFrame:
    """The kinds of other sources within 15 m of each sensor."""
    other = t.sensors.select(F.col("kind").alias("k2"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    near = spatial.within(t.sensors, other, 15.0, also=F.col("kind") != F.col("k2")).groupBy("sensor_id").agg(F.array_join(F.array_sort(F.collect_set("k2")), ",").alias("kinds"))
    return near


CANDS = "SELECT trip_id, k AS cand, trip_miles * 1609.344e0 AS d_m, dur_min * 60.0e0 AS t_obs, trip_miles * 1609.344e0 * (1.0e0 + k * 0.2e0) AS len_m, trip_miles * (150.0e0 - k * 60.0e0) AS t_r FROM v_trips CROSS JOIN (SELECT CAST(0 AS BIGINT) AS k UNION ALL SELECT 1) c"


def infer_score(len_m, t_r, d_m, t_obs, mu: float = 0.5877866649, tau: float = 0.55, sigma: float = 0.35):
    """How well a candidate route explains a trip's distance and duration; 0 without either."""
    dl = (F.col(len_m) - F.col(d_m)) / F.col(d_m)
    z = (F.log(F.col(t_obs) / F.col(t_r)) - mu) / tau
    return F.when((F.col(t_r) <= 1) | (F.col(d_m) <= 0) | (F.col(t_obs) <= 0), 0.0).otherwise(F.exp(-dl * dl / (2 * sigma * sigma)) * F.exp(-0.5 * z * z))


@query("q_route_inference", f"SELECT trip_id, cand, ROUND(s, 6) AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY ROUND(s, 9) DESC, cand) AS rn FROM (SELECT trip_id, cand, CASE WHEN t_r <= 1 OR d_m <= 0 OR t_obs <= 0 THEN 0.0e0 ELSE EXP(-(((len_m - d_m) / d_m) ** 2) / (2 * 0.1225e0)) * EXP(-0.5e0 * ((LN(t_obs / t_r) - 0.5877866649e0) / 0.55e0) ** 2) END AS s FROM ({CANDS}) c) q) w WHERE rn = 1")
def q_route_inference(t: Tables) -> DataFrame:
    c = t.sql(CANDS).withColumn("s", infer_score("len_m", "t_r", "d_m", "t_obs"))
    best = c.groupBy("trip_id").agg(F.min(F.struct(-F.round("s", 9), "cand", "s")).alias("b"))
    return best.select("trip_id", "b.cand", F.round("b.s", 6).alias("score"))


SERVICE_DAY = "20240117"  # a Wednesday
FEED_TRIPS = "SELECT CAST(l_orderkey AS BIGINT) AS trip_id, CAST(MIN(l_suppkey) AS BIGINT) AS route_id, MIN(o_custkey) % 25 AS service FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey"
FEED_STOPS = "SELECT CAST(p_partkey AS BIGINT) AS stop_id, (p_partkey * 7919 % 20000) / 10.0e0 - 1000.0e0 AS px, (p_partkey * 104729 % 20000) / 10.0e0 - 1000.0e0 AS py FROM part"


def feed(t: Tables) -> tuple[dict[str, DataFrame], DataFrame]:
    """A timetable feed and a list of enforced routes, written as files from the tables and read back.

    Orders are trips, of the route of their first supplier; line items are their stops, a few without a time; nations are
    services, some of them expired, added or removed for the day."""
    path, text = place(t, "feed"), lambda c: F.col(c).cast("string")
    route = F.concat(F.lit("m"), F.col("s_suppkey"), F.expr("CASE s_suppkey % 3 WHEN 0 THEN '-SBS' WHEN 1 THEN '' ELSE '+' END"))
    minute = F.expr("l_orderkey * 7 % 1400 + 2 * l_linenumber")
    clock = F.when(F.expr("l_orderkey % 11 = 0 AND l_linenumber = 5"), "x").otherwise(F.format_string("%02d:%02d:00", F.floor(minute / 60), minute % 60))
    degrees = lambda c: F.concat(F.lit("  "), c.cast("string"))
    flags = [F.expr(f"CASE WHEN (n_nationkey + {k}) % 3 <> 0 THEN '1' ELSE '0' END").alias(day) for k, day in enumerate(timetable.WEEKDAYS)]
    made = {
        "routes": t.supplier.select(text("s_suppkey").alias("route_id"), route.alias("route_short_name"), F.lit("").alias("route_long_name")),
        "trips": t.sql(FEED_TRIPS).select(text("route_id").alias("route_id"), F.concat(F.lit("S"), "service").alias("service_id"), text("trip_id").alias("trip_id"), F.lit("0").alias("direction_id"), text("route_id").alias("shape_id")),
        "stops": t.sql(FEED_STOPS).select(text("stop_id").alias("stop_id"), F.lit("").alias("stop_name"), degrees(geo.enu_lat("py")).alias("stop_lat"), degrees(geo.enu_lon("px")).alias("stop_lon")),
        "stop_times": t.lineitem.select(text("l_orderkey").alias("trip_id"), clock.alias("arrival_time"), clock.alias("departure_time"), text("l_partkey").alias("stop_id"), text("l_linenumber").alias("stop_sequence")),
        "shapes": t.route_points.select(text("route_id").alias("shape_id"), degrees(geo.enu_lat("y")).alias("shape_pt_lat"), degrees(geo.enu_lon("x")).alias("shape_pt_lon"), text("seq").alias("shape_pt_sequence")),
        "calendar": t.nation.select(F.concat(F.lit("S"), "n_nationkey").alias("service_id"), *flags, F.lit("20240101").alias("start_date"), F.expr("CASE WHEN n_nationkey % 5 = 0 THEN '20240110' ELSE '20241231' END").alias("end_date")),
        "calendar_dates": t.nation.where("n_nationkey % 4 > 0").select(F.concat(F.lit("S"), "n_nationkey").alias("service_id"), F.expr(f"CASE WHEN n_nationkey % 4 = 3 THEN '20240118' ELSE '{SERVICE_DAY}' END").alias("date"), F.expr("CASE WHEN n_nationkey % 4 = 2 THEN '2' ELSE '1' END").alias("exception_type")),
    }
    for name, df in made.items():
        df.write.option("header", True).csv(f"{path}/{name}.txt")
    listed = F.struct(F.concat(F.lit("M"), "s_suppkey").alias("route"), F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'ACE' WHEN 2 THEN 'ace' ELSE 'ABLE' END").alias("program"))
    documents(t.supplier, "s_suppkey", F.to_json(F.collect_list(listed))).write.text(f"{path}/enforced")
    return readers.gtfs(t.spark, path), readers.json_rows(t.spark, f"{path}/enforced", "route string, program string")


ACTIVE = "SELECT n_nationkey AS service FROM nation WHERE (((n_nationkey + 2) % 3 <> 0 AND n_nationkey % 5 <> 0) OR n_nationkey % 4 = 1) AND n_nationkey % 4 <> 2"
SERVED = f"""SELECT t.trip_id, t.route_id, l_linenumber AS seq, s.stop_id, CAST(l_orderkey * 7 % 1400 + 2 * l_linenumber AS DOUBLE) AS minute, px, py FROM ({FEED_TRIPS}) t JOIN ({ACTIVE}) a ON a.service = t.service
  JOIN lineitem ON l_orderkey = t.trip_id JOIN ({FEED_STOPS}) s ON s.stop_id = l_partkey WHERE t.route_id % 2 = 0 AND NOT (l_orderkey % 11 = 0 AND l_linenumber = 5)"""
NEAREST = f"""SELECT route_id, stop_id, arc FROM (SELECT route_id, stop_id, a0 + tt * (a1 - a0) AS arc,
    ROW_NUMBER() OVER (PARTITION BY route_id, stop_id ORDER BY ROUND((px - x0 - tt * (x1 - x0)) ** 2 + (py - y0 - tt * (y1 - y0)) ** 2, 6), seq) AS rn FROM
  (SELECT p.route_id, p.stop_id, p.px, p.py, s.*, GREATEST(0.0e0, LEAST(1.0e0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS tt
   FROM (SELECT DISTINCT route_id, stop_id, px, py FROM ({SERVED}) q) p JOIN (SELECT route_id AS shape, seq, a0, a1, x0, y0, x1, y1 FROM ({STRETCH}) z WHERE a1 IS NOT NULL) s ON s.shape = p.route_id) w) r WHERE rn = 1"""


@query("q_bus_day", f"""SELECT trip_id, COUNT(*) AS frames, MIN(minute) AS start_min, MAX(minute) AS end_min, ROUND(MAX(arc), 3) AS arc, ROUND(SUM(arc), 2) AS arcs FROM
  (SELECT v.trip_id, v.minute, MAX(n.arc) OVER (PARTITION BY v.trip_id ORDER BY v.seq, CAST(v.stop_id AS VARCHAR) ROWS UNBOUNDED PRECEDING) AS arc FROM ({SERVED}) v JOIN ({NEAREST}) n ON n.route_id = v.route_id AND n.stop_id = v.stop_id) k
  GROUP BY trip_id HAVING COUNT(*) >= 2""")
def q_bus_day(t: Tables) -> DataFrame:
    """The enforced trips of one service day from a feed's files, their stops placed forward along their shapes."""
    files, listed = feed(t)
    frames = timetable.keyframes(files, timetable.enforced_routes(files["routes"], listed, True), SERVICE_DAY)
    out = frames.groupBy(F.col("trip_id").cast("long").alias("trip_id")).agg(F.count("*").alias("frames"), F.min("minute").alias("start_min"), F.max("minute").alias("end_min"), F.round(F.max("arc"), 3).alias("arc"), F.round(F.sum("arc"), 2).alias("arcs"))
    return out


@query("q_ace_corridors", f"""SELECT route_id, seq, ROUND(SQRT((x1 - x0) ** 2 + (y1 - y0) ** 2), 4) AS len FROM ({STRETCH}) s
  WHERE a1 IS NOT NULL AND route_id % 2 = 0 AND route_id IN (SELECT route_id FROM ({FEED_TRIPS}) t)""")
def q_ace_corridors(t: Tables) -> DataFrame:
    """The shapes of enforced routes from a feed's files: matched by base name, joined over trips."""
    files, listed = feed(t)
    segments = timetable.corridors(files, timetable.enforced_routes(files["routes"], listed, True))
    return segments.select(F.col("shape_id").cast("long").alias("route_id"), "seq", F.round(geo.distance("x0", "y0", "x1", "y1"), 4).alias("len"))


SAMPLES = f"""SELECT s.route_id, k, x0 + (x1 - x0) * (arc - a0) / (a1 - a0) AS x, y0 + (y1 - y0) * (arc - a0) / (a1 - a0) AS y FROM
  (SELECT route_id, k, LEAST(total, total * k / n) AS arc FROM (SELECT DISTINCT route_id, total, CEIL(total / 16.0e0) AS n FROM ({STRETCH}) z) q JOIN (SELECT CAST(UNNEST(RANGE(1, 400)) AS DOUBLE) AS k) i ON k <= n) w
  JOIN ({STRETCH}) s ON s.route_id = w.route_id WHERE a1 IS NOT NULL AND arc >= a0 AND (arc < a1 OR (a1 = total AND arc <= a1))"""
SNAPPED = f"""SELECT route_id, k, edge_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY route_id, k ORDER BY d2, edge_id) AS rn FROM
  (SELECT s.route_id, s.k, e.edge_id, ROUND((s.x - e.x0 - {EDGE_T} * (e.x1 - e.x0)) ** 2 + (s.y - e.y0 - {EDGE_T} * (e.y1 - e.y0)) ** 2, 6) AS d2
   FROM ({SAMPLES}) s JOIN v_edges e ON s.x BETWEEN e.x0 - 40 AND e.x1 + 40 AND s.y BETWEEN e.y0 - 40 AND e.y1 + 40) q WHERE d2 < 35.0e0 * 35.0e0) w WHERE rn = 1"""


@query("q_roving_coverage", f"""SELECT edge_id, CAST(SUM(n) AS BIGINT) AS entries FROM (SELECT route_id, edge_id FROM (SELECT *, LAG(edge_id) OVER (PARTITION BY route_id ORDER BY k) AS before FROM ({SNAPPED}) s) q WHERE before IS NULL OR before <> edge_id) e
  JOIN (SELECT route_id, COUNT(*) AS n FROM ({TRIP_ROUTE}) t GROUP BY route_id) n ON n.route_id = e.route_id GROUP BY edge_id""")
def q_roving_coverage(t: Tables) -> DataFrame:
    """How often the day's trips enter each street. Trips of one route enter the same streets, so a route is walked once."""
    trips = t.sql(TRIP_ROUTE).groupBy("route_id").agg(F.count("*").alias("trips"))
    entered = fleet.street_entries(t.route_points, t.edges, "route_id").join(trips, "route_id")
    return entered.groupBy("edge_id").agg(F.sum(F.col("entries") * F.col("trips")).alias("entries"))


@query("q_concurrency", ag.SUMMARY)
def q_concurrency(t: Tables) -> DataFrame:
    return ag.concurrency_summary(ag.concurrency(t.trip_rows))


@query("q_sensing_power", ag.POWER)
def q_sensing_power(t: Tables) -> DataFrame:
    return ag.sensing_power(ag.traversal_histogram(t), F.col("m"), 880).withColumn("coverage", F.round("coverage", 8))


FIELD = f"SELECT zone_id, ROUND(CASE WHEN area > 0 THEN LEAST(8.0e0, n / area / (SELECT median FROM ({ag.MEDIAN}) m)) ELSE 0.0e0 END, 6) AS intensity FROM ({ag.DENSITY}) q"


@query("q_dashcam_field", FIELD)
def q_dashcam_field(t: Tables) -> DataFrame:
    return ag.agg_density_intensity(t)


REGISTERED = f"""SELECT a.zone_id, area, COALESCE(n, 0) AS n FROM (SELECT zone_id, ABS(SUM(x0 * y1 - x1 * y0)) / 2 AS area FROM ({RING_EDGES}) e GROUP BY zone_id) a
  LEFT JOIN (SELECT c_nationkey, COUNT(*) AS n FROM customer WHERE c_mktsegment = 'AUTOMOBILE' GROUP BY c_nationkey) c ON c.c_nationkey = a.zone_id"""


@query("q_tesla_field", f"SELECT zone_id, ROUND(CASE WHEN area > 0 THEN LEAST(8.0e0, n / area / (SELECT median FROM ({ag.MEDIAN.replace(ag.DENSITY, REGISTERED)}) m)) ELSE 0.0e0 END, 6) AS intensity FROM ({REGISTERED}) q")
def q_tesla_field(t: Tables) -> DataFrame:
    """Registered cars for each area of a zone's own ring; customers of one segment stand for the registrations."""
    areas = t.zone_rings.select("zone_id", geo.ring_area("ring").alias("area"))
    counts = t.customer.where("c_mktsegment = 'AUTOMOBILE'").groupBy(F.col("c_nationkey").cast("long").alias("zone_id")).agg(F.count("*").alias("n"))
    return ag.density_intensity(counts, areas, "zone_id").select("zone_id", F.round("intensity", 6).alias("intensity"))


RASTER = """SELECT g.cx, g.cy, s.score FROM (SELECT k % 80 - 40 AS cx, CAST(FLOOR(k / 80.0e0) AS BIGINT) - 40 AS cy FROM (SELECT CAST(UNNEST(RANGE(0, 6400)) AS BIGINT) AS k) n) g LEFT JOIN
  (SELECT CAST(FLOOR(x / 25.0e0) AS BIGINT) AS cx, CAST(FLOOR(y / 25.0e0) AS BIGINT) AS cy, AVG(facility_id % 10 / 10.0e0) AS score FROM v_facilities GROUP BY 1, 2) s ON s.cx = g.cx AND s.cy = g.cy"""


def filled_sql(passes: int) -> str:
    """RASTER after passes, each a table expression over the one before."""
    step = "c{j} AS (SELECT c.cx, c.cy, COALESCE(ANY_VALUE(c.score), AVG(n.score)) AS score FROM c{i} c CROSS JOIN (SELECT UNNEST(RANGE(-1, 2)) AS dx) a CROSS JOIN (SELECT UNNEST(RANGE(-1, 2)) AS dy) b LEFT JOIN c{i} n ON n.cx = c.cx + dx AND n.cy = c.cy + dy GROUP BY c.cx, c.cy)"
    steps = ", ".join(step.format(i=i, j=i + 1) for i in range(passes))
    return f"WITH c0 AS ({RASTER}), {steps} SELECT cx, cy, ROUND(score, 6) AS score FROM c{passes}"


@query("q_robot_field", filled_sql(8))
def q_robot_field(t: Tables) -> DataFrame:
    """Cell means, then eight passes that fill empty cells with the mean of their filled neighbours."""
    return flood_fill(raster(t), 8).select("cx", "cy", F.round("score", 6).alias("score"))


def raster(t: Tables) -> DataFrame:
    """Mean score of the facilities in each cell of 25 m; null where there are none."""
    cells = t.facilities.groupBy(spatial.cell("x", 25.0).alias("cx"), spatial.cell("y", 25.0).alias("cy")).agg(F.avg(F.expr("facility_id % 10 / 10.0e0")).alias("score"))
    grid = t.spark.range(6400).select((F.col("id") % 80 - 40).alias("cx"), (F.floor(F.col("id") / 80) - 40).alias("cy"))
    return grid.join(cells, ["cx", "cy"], "left")


def flood_fill(cells: DataFrame, passes: int) -> DataFrame:
    """cells(cx, cy, score): in each pass an empty cell takes the mean of its filled eight neighbours before the pass."""
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)))
    for _ in range(passes):
        near = cells.where("score IS NOT NULL").withColumn("d", around).groupBy((F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy")).agg(F.avg("score").alias("near"))
        cells = graph.checkpointed(cells.join(near, ["cx", "cy"], "left").select("cx", "cy", F.coalesce("score", "near").alias("score")))
    return cells


#: Each class's reach in metres and the chance that a pass is a capture. The type of event stands for the class.
LIVE_CLASSES = {
    "vehicle": ("view", 22.0, 1.0),
    "glasses": ("click", 6.0, 0.0002),
    "bus": ("purchase", 22.0, 0.7),
    "robot": ("signup", 8.0, 0.5),
    "tesla": ("error", 20.0, 0.3),
}
DRAW_MOD, DRAW_FACTOR = 2147483647, 16807
DRAW = "((event_id * 48271 + facility_id * 69621) * 16807 % 2147483647) / 2147483647.0e0"
LIVE_PASS = "CASE event_type " + " ".join(f"WHEN '{e}' THEN d2 <= {r * r}e0 AND draw < {p}e0" for e, r, p in LIVE_CLASSES.values()) + " ELSE FALSE END"
LIVE_COUNTS = {n: f"COUNT(CASE WHEN event_type = '{e}' THEN 1 END)" for n, (e, _, _) in LIVE_CLASSES.items()}


@query("q_live_walk", f"""SELECT facility_id, {', '.join(f'{c} AS {n}' for n, c in LIVE_COUNTS.items())} FROM (SELECT facility_id, event_type, {DRAW} AS draw, (p.x - s.sx) ** 2 + (p.y - s.sy) ** 2 AS d2
  FROM v_pings p JOIN ({SITES}) s ON ABS(p.x - s.sx) <= 22 AND ABS(p.y - s.sy) <= 22) q WHERE {LIVE_PASS} GROUP BY facility_id""")
def q_live_walk(t: Tables) -> DataFrame:
    """Captures of a walker who stands at each facility, by class: passes within the class's reach, kept by a draw of event
    and facility below the class's chance."""
    return live_captures(t.pings, sites(t))


def live_captures(pings: DataFrame, walkers: DataFrame) -> DataFrame:
    """pings(event_id, event_type, x, y), walkers(facility_id, sx, sy) -> (facility_id, a count for each class) of walkers with
    any capture. Ids are not negative.

    A draw is the sum of a number of the event and one of the facility, modulo DRAW_MOD; so the events that a facility keeps
    are those whose numbers lie in one range of a circle. Events meet each place once, whatever number of facilities is
    there, and are sorted by place and class with the ends of the facilities' ranges: what a range holds is the difference of
    the running counts at its ends."""
    place, none = ["sx", "sy", "event_type"], F.lit(None).cast("long")
    events = live_passes(pings, walkers).select(*place, draw_part("event_id", 48271).alias("at"), F.lit(1).alias("event"), none.alias("facility_id"), F.lit(0).alias("sign"))
    ends = F.explode(F.concat(*(range_ends(e, p) for e, _, p in LIVE_CLASSES.values())))
    ranges = walkers.where("facility_id IS NOT NULL").withColumn("low", F.pmod(-draw_part("facility_id", 69621), F.lit(DRAW_MOD))).select("sx", "sy", "facility_id", ends.alias("end"))
    ends = ranges.select("sx", "sy", "end.event_type", "end.at", F.lit(0).alias("event"), "facility_id", "end.sign")
    before = Window.partitionBy(*place).orderBy("at", "event").rowsBetween(Window.unboundedPreceding, 0)
    found = events.union(ends).withColumn("n", F.sum("event").over(before)).where("event = 0")
    counts = found.groupBy("facility_id").agg(*(F.coalesce(F.sum(F.when(F.col("event_type") == e, F.col("sign") * F.col("n"))), F.lit(0)).alias(n) for n, (e, _, _) in LIVE_CLASSES.items()))
    return counts.where(" + ".join(LIVE_CLASSES) + " > 0")


def live_passes(pings: DataFrame, walkers: DataFrame) -> DataFrame:
    """pings with each place of walkers that lies within their class's reach, once."""
    classes = LIVE_CLASSES.values()
    radius = F.create_map(*(F.lit(v) for e, r, _ in classes for v in (e, r * r)))
    known = pings.where(F.col("event_id").isNotNull() & F.col("event_type").isin(*(e for e, _, _ in classes)))
    met = spatial.within(known, walkers.select("sx", "sy").distinct(), max(r for _, r, _ in classes))
    return met.where(geo.distance2("x", "y", "sx", "sy") <= radius[F.col("event_type")])


def draw_part(key: str, factor: int):
    """What a key adds to the number of a draw, modulo DRAW_MOD."""
    return F.pmod(F.pmod(key, F.lit(DRAW_MOD)) * F.lit(factor * DRAW_FACTOR % DRAW_MOD), F.lit(DRAW_MOD))


def range_ends(event_type: str, chance: float):
    """The ends (event_type, at, sign) of the range from `low` on, around the circle of DRAW_MOD, whose numbers make a draw below
    the chance: what lies below the ends, added with their signs, is what the range holds."""
    size = math.ceil(chance * DRAW_MOD)
    size += next(k for k in (-1, 0, 1, 2) if not (size + k) / DRAW_MOD < chance)  # the first number that is no longer below
    end = lambda at, sign: F.struct(F.lit(event_type).alias("event_type"), at.cast("long").alias("at"), F.lit(sign).alias("sign"))
    all_, low, high = F.lit(DRAW_MOD), F.col("low"), F.col("low") + size
    if size >= DRAW_MOD:
        return F.array(end(all_, 1))
    return F.when(high <= DRAW_MOD, F.array(end(low, -1), end(high, 1))).otherwise(F.array(end(low, -1), end(all_, 1), end(high - DRAW_MOD, 1)))


@query("q_population_scale", f"""SELECT hour, CAST(ROUND(LEAST(2000.0e0, 2000 * {curve_sql('hour', 0.1, 9.0, 18.0)})) AS BIGINT) AS peds, CAST(ROUND(LEAST(300.0e0, 300 * {curve_sql('hour', 0.05, 12.0, 18.5)})) AS BIGINT) AS robots,
  CAST(ROUND(LEAST(500.0e0, 500 * (0.4e0 + 0.6e0 * {curve_sql('hour', 0.12, 8.5, 17.5)}))) AS BIGINT) AS teslas FROM (SELECT CAST(UNNEST(RANGE(0, 48)) AS DOUBLE) / 2 AS hour) h""")
def q_population_scale(t: Tables) -> DataFrame:
    hours = t.spark.range(48).select((F.col("id") / 2).alias("hour"))
    return hours.select("hour", *(c.alias(n) for n, c in population(F.col("hour")).items()))


def population(hour, peds: int = 2000, robots: int = 300, teslas: int = 500, per_1000: float = 10.0, robot_density: float = 2.0, tesla_density: float = 4.0) -> dict:
    """Agents wanted at an hour, under the sliders."""
    want = lambda most, scale: F.round(geo.clamp(most * scale, 0.0, float(most))).cast("long")
    return {
        "peds": want(peds, scalar.pedestrians(hour) * (per_1000 / 10)),
        "robots": want(robots, scalar.robots(hour) * (robot_density / 2)),
        "teslas": want(teslas, (0.4 + 0.6 * scalar.traffic(hour)) * (tesla_density / 4)),
    }


