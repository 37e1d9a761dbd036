"""Geometry rewrites and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import geo, scalar
from kerbside.operators import geometry, graph, polygons, sequence, spatial

from .composites import HOPS, filled_sql, flood_fill, raster
from .joins import CC, CLOSED, clusters, not_colinear
from .registry import query
from .scalars import r
from .views import Tables


def polylines(t: Tables) -> DataFrame:
    return geometry.rings(t.route_points, "route_id", "seq").select("route_id", F.col("ring").alias("points"))


@query("rdp_simplify")
def rdp_simplify(t: Tables) -> DataFrame:
    return polylines(t).select("route_id", F.size(geometry.rdp_simplify(5.0)("points")).cast("long").alias("kept"))


@query("dp_decimate")
def dp_decimate(t: Tables) -> DataFrame:
    return polylines(t).select("route_id", F.size(geometry.dp_decimate(6.0)("points")).cast("long").alias("kept"))


def _centre_box(t: Tables) -> DataFrame:
    corners = [(-500.0, -500.0), (500.0, -500.0), (500.0, 500.0), (-500.0, 500.0)]
    return t.spark.range(1).select(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners)).alias("clip"))


@query("clip_polyline")
def clip_polyline(t: Tables) -> DataFrame:
    clipped = polylines(t).crossJoin(F.broadcast(_centre_box(t))).withColumn("runs", geometry.clip_polyline("points", "clip"))
    return clipped.select("route_id", F.posexplode("runs").alias("run", "line")).select("route_id", F.col("run").cast("long").alias("run"), F.size("line").cast("long").alias("points"))


@query("longest_run")
def longest_run(t: Tables) -> DataFrame:
    """The run with most points; the last on ties."""
    return clip_polyline(t).groupBy("route_id").agg(F.max_by("run", F.struct("points", "run")).alias("run"), F.max("points").alias("points"))


#: Land with a bay and a lake, as rings; all its edges run along the axes, so SQL can give areas by rectangles.
LAND = (
    ((-700.0, -600.0), (800.0, -600.0), (800.0, 700.0), (250.0, 700.0), (250.0, 200.0), (-100.0, 200.0), (-100.0, 700.0), (-700.0, 700.0)),
    ((300.0, -300.0), (300.0, 0.0), (600.0, 0.0), (600.0, -300.0)),
)
PARCEL_M = 30.0


def _overlap_sql(x0: float, y0: float, x1: float, y1: float) -> str:
    return f"GREATEST(0.0e0, LEAST(x + 30, {x1}e0) - GREATEST(x - 30, {x0}e0)) * GREATEST(0.0e0, LEAST(y + 30, {y1}e0) - GREATEST(y - 30, {y0}e0))"


@query("clip_polygon", f"""SELECT facility_id, ROUND(land, 4) + 0.0e0 AS land, ROUND(3600 - land, 4) + 0.0e0 AS water FROM
  (SELECT facility_id, {_overlap_sql(-700.0, -600.0, 800.0, 700.0)} - {_overlap_sql(-100.0, 200.0, 250.0, 700.0)} - {_overlap_sql(300.0, -300.0, 600.0, 0.0)} AS land FROM v_facilities) q""")
def clip_polygon(t: Tables) -> DataFrame:
    """How much of each facility's square parcel is on land and how much in water: intersection and difference with a concave
    polygon that has a hole."""
    point = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    land = F.array(*(F.array(*(point(x, y) for x, y in ring)) for ring in LAND))
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    parcel = F.array(F.array(*(F.struct((F.col("x") + a * PARCEL_M).alias("x"), (F.col("y") + b * PARCEL_M).alias("y")) for a, b in corners)))
    # facilities at one place share a parcel; distinct ones are dealt to all cores, as a small table is one part
    places = t.facilities.select("x", "y").distinct().repartition(max(8, 4 * t.spark.sparkContext.defaultParallelism), "x", "y")
    rows = places.select("x", "y", parcel.alias("parcel"), land.alias("land"))
    areas = {n: F.round(polygons.parts_area(f("parcel", "land")), 4) + 0.0 for n, f in (("land", polygons.intersection), ("water", polygons.difference))}
    return t.facilities.join(rows.select("x", "y", *(c.alias(n) for n, c in areas.items())), ["x", "y"]).select("facility_id", "land", "water")


@query("significant_parts", "SELECT grp, part, rank FROM (SELECT grp, part, area, MAX(area) OVER (PARTITION BY grp) AS top, CAST(ROW_NUMBER() OVER (PARTITION BY grp ORDER BY area DESC, part) AS BIGINT) AS rank FROM (SELECT facility_id % 20 AS grp, facility_id AS part, POWER(facility_id * 31 % 97, 4) * 1.0e0 AS area FROM v_facilities) q) w WHERE area >= 0.003e0 * top")
def significant_parts(t: Tables) -> DataFrame:
    """A group's largest part and those of 0.3 % of it or more, largest first."""
    parts = t.facilities.select(F.expr("facility_id % 20").alias("grp"), F.col("facility_id").alias("part"), F.expr("POWER(facility_id * 31 % 97, 4) * 1.0e0").alias("area"))
    kept = parts.join(parts.groupBy("grp").agg(F.max("area").alias("top")), "grp").where(F.col("area") >= 0.003 * F.col("top"))
    return kept.select("grp", "part", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("area"), "part")).cast("long").alias("rank"))


@query("densify", "SELECT edge_id, CAST(k AS BIGINT) AS i, x0 + (x1 - x0) * k / 10.0e0 AS x, y0 + (y1 - y0) * k / 10.0e0 AS y FROM v_edges CROSS JOIN (SELECT UNNEST(RANGE(0, 11)) AS k) n")
def densify(t: Tables) -> DataFrame:
    return geometry.densified(t.edges, 10.0).select("edge_id", "i", "x", "y")


@query("rasterize_line", "SELECT DISTINCT edge_id, CAST(FLOOR((x0 + (x1 - x0) * k / 3.0e0) / 60.0e0) AS BIGINT) AS cx, CAST(FLOOR((y0 + (y1 - y0) * k / 3.0e0) / 60.0e0) AS BIGINT) AS cy FROM v_edges CROSS JOIN (SELECT UNNEST(RANGE(0, 4)) AS k) n")
def rasterize_line(t: Tables) -> DataFrame:
    return geometry.rasterized(t.edges, "edge_id", 60.0)


@query("convex_hull")
def convex_hull(t: Tables) -> DataFrame:
    hulls = geometry.convex_hulls(t.sensors.withColumn("zone", F.pmod("sensor_id", F.lit(10))), "zone")
    return hulls.select("zone", F.size("hull").cast("long").alias("corners"), F.round(geo.ring_area("hull"), 4).alias("area"))


@query("flood_fill", filled_sql(1))
def flood_fill_once(t: Tables) -> DataFrame:
    return flood_fill(raster(t), 1).select("cx", "cy", F.round("score", 6).alias("score"))


WAYS = "SELECT CAST(l_orderkey AS BIGINT) AS way, CAST(l_linenumber AS BIGINT) AS seq, CAST(l_partkey AS BIGINT) AS node FROM lineitem"


@query("split_ways", f"""SELECT way, part, COUNT(*) AS nodes FROM (SELECT way, CAST(COALESCE(SUM(cut) OVER (PARTITION BY way ORDER BY seq, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS part FROM
  (SELECT w.way, w.seq, w.node, CASE WHEN u.uses >= 2 AND ROW_NUMBER() OVER (PARTITION BY w.way ORDER BY w.seq, w.node) > 1 THEN 1 ELSE 0 END AS cut FROM ({WAYS}) w JOIN (SELECT node, COUNT(*) AS uses FROM ({WAYS}) v GROUP BY node) u ON u.node = w.node) q) z GROUP BY way, part""")
def split_ways_(t: Tables) -> DataFrame:
    return split_ways(t.sql(WAYS)).groupBy("way", "part").agg(F.count("*").alias("nodes"))


def split_ways(ways: DataFrame) -> DataFrame:
    """ways(way, seq, node) with `part`: a new edge begins after each node, but a way's first, that is used twice or more."""
    uses = ways.groupBy("node").agg(F.count("*").alias("uses"))
    w = sequence.over("way", "seq", "node")
    q = ways.join(uses, "node").withColumn("cut", ((F.col("uses") >= 2) & (F.row_number().over(w) > 1)).cast("long"))
    return q.withColumn("part", F.coalesce(F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("cut", "uses")


@query("snap_nodes", "SELECT CAST(ROUND(x / 40) AS BIGINT) AS kx, CAST(ROUND(y / 40) AS BIGINT) AS ky, ARG_MIN(x, sensor_id) AS x, ARG_MIN(y, sensor_id) AS y FROM v_sensors GROUP BY 1, 2")
def snap_nodes(t: Tables) -> DataFrame:
    """Rounded places; the first sensor's place stands for each."""
    return snapped(t.sensors, 40.0, "sensor_id")


def snapped(points: DataFrame, grid: float, order: str) -> DataFrame:
    k = {n: F.round(F.col(c) / grid).cast("long") for n, c in (("kx", "x"), ("ky", "y"))}
    first = points.select(*(v.alias(n) for n, v in k.items()), F.struct(order, "x", "y").alias("p")).groupBy("kx", "ky").agg(F.min("p").alias("p"))
    return first.select("kx", "ky", "p.x", "p.y")


CT = "GREATEST(0.0e0, LEAST(1.0e0, ((mx - cx0) * (cx1 - cx0) + (my - cy0) * (cy1 - cy0)) / ((cx1 - cx0) ** 2 + (cy1 - cy0) ** 2)))"


@query("drivability_mask", f"""SELECT e.edge_id FROM (SELECT *, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM v_edges) e WHERE edge_id % 13 NOT IN (5, 6) AND NOT (edge_id % 11 = 3 AND edge_id % 13 NOT IN (2, 9)) AND NOT EXISTS (SELECT 1 FROM v_zones z WHERE zone_id % 6 = 0 AND mx > minx AND mx < maxx AND my > miny AND my < maxy AND edge_id % 2 = 0)
  AND NOT EXISTS (SELECT 1 FROM ({CLOSED}) c WHERE ABS(((x1 - x0) * (cx1 - cx0) + (y1 - y0) * (cy1 - cy0)) / (length_m * SQRT((cx1 - cx0) ** 2 + (cy1 - cy0) ** 2))) > 0.87e0 AND (mx - cx0 - {CT} * (cx1 - cx0)) ** 2 + (my - cy0 - {CT} * (cy1 - cy0)) ** 2 < 100.0e0)""")
def drivability_mask(t: Tables) -> DataFrame:
    """Road class, no vehicles (but on highways and ramps), footways in parks, and closed streets."""
    rw = F.col("edge_id") % 13
    e = t.edges.withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2})
    e = e.where(~rw.isin(5, 6) & ~((F.col("edge_id") % 11 == 3) & ~rw.isin(2, 9)))
    parks = spatial.dealt_box(t.zones.where("zone_id % 6 = 0"), "minx", "miny", "maxx", "maxy", 400.0)
    strictly = (F.col("mx") > F.col("minx")) & (F.col("mx") < F.col("maxx")) & (F.col("my") > F.col("miny")) & (F.col("my") < F.col("maxy"))
    e = spatial.cell_join(spatial.dealt_point(e, "mx", "my", 400.0), parks, strictly & (F.col("edge_id") % 2 == 0), "left_anti")
    closed = sequence.segments(t.route_points, "route_id")
    return not_colinear(e.drop("mx", "my"), closed, 10.0).select("edge_id")


@query("pca_axis", "SELECT grp, ROUND(ATAN2(2 * COVAR_POP(x, y), VAR_POP(x) - VAR_POP(y)) / 2, 6) + 0.0e0 AS axis FROM (SELECT sensor_id % 10 AS grp, x, y FROM v_sensors) q GROUP BY grp")
def pca_axis(t: Tables) -> DataFrame:
    return t.sensors.groupBy(F.expr("sensor_id % 10").alias("grp")).agg(r(F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y")) / 2).alias("axis"))


# Graphs


@query("graph_neighbors", "SELECT from_id AS src, to_id AS dst, edge_id FROM v_edges UNION ALL SELECT to_id, from_id, edge_id FROM v_edges")
def graph_neighbors(t: Tables) -> DataFrame:
    return graph.adjacency(t.edges)


#: Streets of uneven length, with their ends' places, of the grid that grows with the tables.
STREETS = """(SELECT e.edge_id, e.from_id, e.to_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, 80.0e0 + (e.edge_id * 7919 % 99991) / 1000.0e0 AS length_m,
  CASE e.edge_id % 3 WHEN 0 THEN 25 WHEN 1 THEN 30 ELSE 50 END AS mph, CASE WHEN e.edge_id % 14 = 2 THEN 8.137e0 ELSE 1.0e0 END AS penalty
  FROM v_street_edges e JOIN v_street_nodes a ON a.node_id = e.from_id JOIN v_street_nodes b ON b.node_id = e.to_id)"""
_GOAL = "CAST(LEAST(side - 1, node % side + {dx}) + side * LEAST(side - 1, CAST(FLOOR(node / (side * 1.0e0)) AS BIGINT) + {dy}) AS BIGINT) AS goal"
#: A start for each supplier, and a goal up to eight blocks east and eight north.
PAIR = f"""SELECT pair_id, CAST(node AS BIGINT) AS start, {_GOAL.format(dx='pair_id * 37 % 9', dy='pair_id * 61 % 9')}
  FROM (SELECT CAST(s_suppkey AS BIGINT) AS pair_id, s_suppkey * 7919 % (side * side) AS node, side FROM supplier CROSS JOIN (SELECT MAX(side) AS side FROM v_street_nodes) n) s"""


def _paths_sql(pairs: str, out: str, weight: str = "length_m", cost: str = "length_m", where: str = "start <> goal") -> str:
    """Least costs from each start by rounds over the edges: a node is kept with its best weight, no farther than straight ways
    can cost; the cost and the number of edges are those of the best."""
    return f"""WITH RECURSIVE pair AS MATERIALIZED ({pairs}), street AS MATERIALIZED (SELECT *, {weight} AS w, {cost} AS c FROM {STREETS} s),
  adj AS MATERIALIZED (SELECT from_id AS a, to_id AS b, w, c FROM street UNION ALL SELECT to_id, from_id, w, c FROM street),
  best (pair_id, node_id, w, c, n) USING KEY (pair_id, node_id) AS (SELECT pair_id, start, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS BIGINT) FROM pair
    UNION SELECT q.pair_id, q.b, MIN(q.w), ARG_MIN(q.c, q.w), ARG_MIN(q.n, q.w) FROM (SELECT p.pair_id, j.b, p.w + j.w AS w, p.c + j.c AS c, p.n + 1 AS n FROM best p JOIN adj j ON j.a = p.node_id) q
      LEFT JOIN recurring.best k ON k.pair_id = q.pair_id AND k.node_id = q.b LEFT JOIN pair g ON g.pair_id = q.pair_id LEFT JOIN recurring.best h ON h.pair_id = q.pair_id AND h.node_id = g.goal
      WHERE (k.w IS NULL OR q.w < k.w) AND (h.w IS NULL OR q.w < h.w) GROUP BY q.pair_id, q.b)
  SELECT {out} FROM pair JOIN best ON best.pair_id = pair.pair_id AND best.node_id = pair.goal WHERE {where}"""


def _paths(t: Tables, pairs: DataFrame, streets: DataFrame, cost: str = "length_m", penalty: str | None = None) -> DataFrame:
    return graph.shortest_paths(pairs, streets, cost, penalty, street_cells(t, CELL_M), 1)


def street_cells(t: Tables, size: float) -> DataFrame:
    """The block of each street node: a square of the map."""
    return t.street_nodes.select("node_id", (F.floor(F.col("x") / size) * 1_000_000 + F.floor(F.col("y") / size)).alias("block"))


def _streets(t: Tables) -> DataFrame:
    return t.sql(f"SELECT * FROM {STREETS} s")


def _totals(paths: DataFrame) -> DataFrame:
    return paths.groupBy("pair_id").agg(F.round(F.max("total"), 6).alias("total"))


@query("graph_shortest_path", _paths_sql(PAIR, "pair.pair_id, ROUND(c, 6) AS total"))
def graph_shortest_path(t: Tables) -> DataFrame:
    return _totals(_paths(t, t.sql(PAIR), _streets(t)))


@query("graph_shortest_time", _paths_sql(PAIR, "pair.pair_id, ROUND(c, 6) AS total", "length_m / (mph * 0.44704e0)", "length_m / (mph * 0.44704e0)"))
def graph_shortest_time(t: Tables) -> DataFrame:
    return _totals(_paths(t, t.sql(PAIR), _streets(t).withColumn("seconds", F.col("length_m") / scalar.class_speed(F.lit(0), F.col("mph"))), "seconds"))


@query("graph_penalised_path", _paths_sql(PAIR, "pair.pair_id, ROUND(c, 6) AS total", "length_m * penalty"))
def graph_penalised_path(t: Tables) -> DataFrame:
    """Highways weigh eight times as much in the search; the totals are true lengths."""
    return _totals(_paths(t, t.sql(PAIR), _streets(t), penalty="penalty"))


STARTS = "SELECT CAST(s_suppkey AS BIGINT) AS source, CAST(s_suppkey * 7919 % n AS BIGINT) AS node_id FROM supplier CROSS JOIN (SELECT COUNT(*) AS n FROM v_street_nodes) c"
#: Metres from a start; side of a block of the street grid.
WALK_M, CELL_M = 600.0, 3200.0


@query("graph_isochrone", f"""WITH RECURSIVE adj AS (SELECT from_id AS a, to_id AS b FROM v_street_edges UNION ALL SELECT to_id, from_id FROM v_street_edges),
  hop AS (SELECT source, node_id, 0 AS d FROM ({STARTS}) s UNION SELECT source, b, d + 1 FROM hop JOIN adj ON a = node_id WHERE d < 6),
  reached AS (SELECT DISTINCT source, node_id FROM hop)
  SELECT p.source, e.edge_id FROM v_street_edges e JOIN reached p ON p.node_id = e.from_id JOIN reached q ON q.node_id = e.to_id AND q.source = p.source""")
def graph_isochrone(t: Tables) -> DataFrame:
    """The streets within a walk of every start, on a grid that grows with the tables, settled cell by cell."""
    reached = graph.reach(t.street_edges, t.sql(STARTS), WALK_M, blocks=street_cells(t, CELL_M))
    return graph.isochrone_edges(t.street_edges, reached).select("source", "edge_id")


@query("graph_build_route", _paths_sql(PAIR, "pair.pair_id, n + 1 AS points"))
def graph_build_route(t: Tables) -> DataFrame:
    streets = _streets(t)
    paths = _paths(t, t.sql(PAIR), streets).join(streets, "edge_id")
    return stitched(paths, t.sql(PAIR)).groupBy("pair_id").agg(F.count("*").alias("points"))


def stitched(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, seq, x, y): the points of each path, every edge turned so that it follows on; joints occur once.

    paths(pair_id, seq, edge_id, from_id, to_id, x0, ...): an edge is forward if its from_id is the node reached so far, which
    is the end that it does not share with the next edge."""
    w = sequence.over("pair_id", "seq")
    q = paths.join(pairs.select("pair_id", "start"), "pair_id").withColumns({"pf": F.lag("from_id").over(w), "pt": F.lag("to_id").over(w)})
    forward = F.when(F.col("pf").isNull(), F.col("from_id") == F.col("start")).otherwise((F.col("from_id") == F.col("pf")) | (F.col("from_id") == F.col("pt")))
    q = q.withColumn("forward", forward)
    end = lambda a, b: F.when(F.col("forward"), F.col(a)).otherwise(F.col(b))
    first = q.where("seq = 0").select("pair_id", F.lit(0).cast("long").alias("seq"), end("x0", "x1").alias("x"), end("y0", "y1").alias("y"))
    return first.union(q.select("pair_id", (F.col("seq") + 1).alias("seq"), end("x1", "x0").alias("x"), end("y1", "y0").alias("y")))


@query("graph_components", CC)
def graph_components(t: Tables) -> DataFrame:
    return clusters(t)


@query("entity_cluster", CC.replace("SELECT node_id, MIN(r) AS component FROM walk GROUP BY node_id", "SELECT component, COUNT(*) AS members, BOOL_OR(kind <> 'FixedCctv') AS confirmed FROM (SELECT node_id, MIN(r) AS component FROM walk GROUP BY node_id) c JOIN v_sensors s ON s.sensor_id = c.node_id GROUP BY component"))
def entity_cluster(t: Tables) -> DataFrame:
    from kerbside.operators.exposure import grouped

    return grouped(t.sensors, clusters(t)).groupBy(F.col("grp").alias("component")).agg(F.count("*").alias("members"), F.bool_or("confirmed").alias("confirmed"))


WALKERS = "SELECT CAST(c_custkey AS BIGINT) AS walk_id, CAST(c_custkey * 7919 % n AS BIGINT) AS node_id FROM customer CROSS JOIN (SELECT COUNT(*) AS n FROM v_street_nodes) s"


@query("graph_random_walk", f"""WITH RECURSIVE near AS MATERIALIZED (SELECT a, LIST({{'e': edge_id, 'b': b}} ORDER BY edge_id) AS out FROM (SELECT from_id AS a, to_id AS b, edge_id FROM v_street_edges UNION ALL SELECT to_id, from_id, edge_id FROM v_street_edges) j GROUP BY a),
  walk AS (SELECT walk_id, CAST(0 AS BIGINT) AS step, node_id, CAST(-1 AS BIGINT) AS last FROM ({WALKERS}) w
    UNION ALL SELECT walk_id, step + 1, ahead[pick].b, ahead[pick].e FROM (SELECT *, CAST(('0x' || SUBSTR(MD5('7:' || walk_id || ':' || (step + 1)), 1, 8)) AS BIGINT) * LEN(ahead) // 4294967296 + 1 AS pick FROM
      (SELECT w.walk_id, w.step, CASE WHEN LEN(out) > 1 THEN LIST_FILTER(out, lambda x: x.e <> w.last) ELSE out END AS ahead FROM walk w JOIN near ON near.a = w.node_id WHERE w.step < 30) q) p)
  SELECT walk_id, step, node_id FROM walk""")
def graph_random_walk(t: Tables) -> DataFrame:
    """Thirty steps of a walk for each customer."""
    return graph.random_walks(t.sql(WALKERS), t.street_edges, 30, 7, street_cells(t, CELL_M), 1).select("walk_id", "step", "node_id")


_TOP = "SELECT pu_zone, do_zone, COUNT(*) AS trips FROM v_trips GROUP BY pu_zone, do_zone ORDER BY trips DESC, pu_zone, do_zone LIMIT 15"
POOL = f"""SELECT pu_zone * 100 + do_zone AS pair_id, trips, CAST(node AS BIGINT) AS start, {_GOAL.format(dx='1 + do_zone % 8', dy='do_zone * 5 % 9')}
  FROM (SELECT t.*, pu_zone * 7919 % (side * side) AS node, side FROM ({_TOP}) t CROSS JOIN (SELECT MAX(side) AS side FROM v_street_nodes) n) s"""


@query("graph_route_pool", _paths_sql(POOL, "pair.pair_id, ROUND(c, 6) AS total, n AS edges, ROUND(trips / (SUM(trips) OVER ()), 8) AS weight"))
def graph_route_pool(t: Tables) -> DataFrame:
    """The most frequent pairs, routed, weights summing to 1."""
    top = graph.checkpointed(t.sql(POOL))
    paths = _paths(t, top, _streets(t)).groupBy("pair_id").agg(F.round(F.max("total"), 6).alias("total"), F.count("*").alias("edges"))
    routed = paths.join(top.select("pair_id", "trips"), "pair_id")
    return routed.crossJoin(F.broadcast(routed.agg(F.sum("trips").alias("all")))).select("pair_id", "total", "edges", F.round(F.col("trips") / F.col("all"), 8).alias("weight"))


@query("graph_edge_incidence", _paths_sql(PAIR, "pair.pair_id, n AS edges"))
def graph_edge_incidence(t: Tables) -> DataFrame:
    return _paths(t, t.sql(PAIR), _streets(t)).groupBy("pair_id").agg(F.count_distinct("edge_id").alias("edges"))
