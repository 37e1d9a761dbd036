"""Projections, scalar functions and predicates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geo, scalar
from kerbside.operators import geometry, spatial

from .registry import query
from .views import Tables


def r(c: Column | str, places: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(geo.col(c), places) + F.lit(0.0)


K = "CAST(c_custkey AS BIGINT) AS id"
LATLON = "40.7e0 + (c_custkey * 7919 % 2000) / 20000.0e0 AS lat, -74.0e0 + (c_custkey * 104729 % 2000) / 20000.0e0 AS lon"


def _latlon(t: Tables) -> DataFrame:
    return t.sql(f"SELECT {K}, {LATLON} FROM customer")


@query("enu_project", f"""SELECT id, ROUND(6371008.8e0 * RADIANS(lon - (-73.9712e0)) * COS(RADIANS(40.7831e0)), 4) + 0.0e0 AS x,
  ROUND(6371008.8e0 * RADIANS(lat - 40.7831e0), 4) + 0.0e0 AS y FROM (SELECT {K}, {LATLON} FROM customer) q""")
def enu_project(t: Tables) -> DataFrame:
    return _latlon(t).select("id", r(geo.enu_x("lon"), 4).alias("x"), r(geo.enu_y("lat"), 4).alias("y"))


@query("enu_inverse", """SELECT sensor_id, ROUND(40.7831e0 + DEGREES(y / 6371008.8e0), 8) AS lat,
  ROUND(-73.9712e0 + DEGREES(x / (6371008.8e0 * COS(RADIANS(40.7831e0)))), 8) AS lon FROM v_sensors""")
def enu_inverse(t: Tables) -> DataFrame:
    return t.sensors.select("sensor_id", F.round(geo.enu_lat("y"), 8).alias("lat"), F.round(geo.enu_lon("x"), 8).alias("lon"))


def _stateplane_sql() -> str:
    """Inverse Lambert conformal conic in steps: the eccentricity, the cone's constants, polar coordinates, eight iterations."""
    m = lambda p: f"COS(RADIANS({p})) / SQRT(1 - POWER(e * SIN(RADIANS({p})), 2))"
    u = lambda p: f"TAN(PI() / 4 - RADIANS({p}) / 2) / POWER((1 - e * SIN(RADIANS({p}))) / (1 + e * SIN(RADIANS({p}))), e / 2)"
    low, high, origin = "(40 + 40 / 60.0e0)", "(41 + 2 / 60.0e0)", "(40 + 10 / 60.0e0)"
    sql = "SELECT SQRT(2 / 298.257222101e0 - POWER(1 / 298.257222101e0, 2)) AS e"
    sql = f"SELECT e, {m(low)} AS m1, {m(high)} AS m2, {u(low)} AS u1, {u(high)} AS u2, {u(origin)} AS u0 FROM ({sql}) a"
    sql = f"SELECT *, (LN(m1) - LN(m2)) / (LN(u1) - LN(u2)) AS n FROM ({sql}) b"
    sql = f"SELECT *, 6378137.0e0 * m1 / (n * POWER(u1, n)) AS scale FROM ({sql}) c"
    sql = f"SELECT sensor_id, e, n, scale, (980000 + x * 10) * 0.3048006096e0 - 300000 AS east, scale * POWER(u0, n) - (200000 + y * 10) * 0.3048006096e0 AS south FROM v_sensors CROSS JOIN ({sql}) d"
    sql = f"SELECT *, POWER(SQRT(east * east + south * south) / scale, 1 / n) AS ts FROM ({sql}) f"
    sql = f"SELECT *, PI() / 2 - 2 * ATAN(ts) AS p FROM ({sql}) g"
    for _ in range(8):
        sql = f"SELECT * REPLACE (PI() / 2 - 2 * ATAN(ts * POWER((1 - e * SIN(p)) / (1 + e * SIN(p)), e / 2)) AS p) FROM ({sql}) h"
    return f"SELECT sensor_id, ROUND(DEGREES(p), 7) AS lat, ROUND(DEGREES(ATAN2(east, south) / n) - 74, 7) AS lon FROM ({sql}) o"


@query("stateplane_to_wgs84", _stateplane_sql())
def stateplane_to_wgs84(t: Tables) -> DataFrame:
    lat, lon = geo.stateplane_to_wgs84(F.lit(980000.0) + F.col("x") * 10, F.lit(200000.0) + F.col("y") * 10)
    return t.sensors.select("sensor_id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query("vec_ops", """SELECT edge_id, x1 - x0 AS dx, y1 - y0 AS dy, ROUND(x0 * x1 + y0 * y1, 6) + 0.0e0 AS dot, ROUND(x0 * y1 - y0 * x1, 6) + 0.0e0 AS crs,
  SQRT((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len, x0 + (x1 - x0) * 0.25e0 AS lx,
  CASE WHEN SQRT(x0 * x0 + y0 * y0) < 1.0e-9 THEN 1.0e0 ELSE ROUND(x0 / SQRT(x0 * x0 + y0 * y0), 6) + 0.0e0 END AS ux FROM v_edges""")
def vec_ops(t: Tables) -> DataFrame:
    ux, _ = geo.normalized("x0", "y0")
    return t.edges.select(
        "edge_id", (F.col("x1") - F.col("x0")).alias("dx"), (F.col("y1") - F.col("y0")).alias("dy"), r(geo.dot("x0", "y0", "x1", "y1")).alias("dot"),
        r(geo.cross("x0", "y0", "x1", "y1")).alias("crs"), geo.distance("x0", "y0", "x1", "y1").alias("len"), geo.lerp("x0", "x1", 0.25).alias("lx"), r(ux).alias("ux"),
    )


@query("bearing", "SELECT sensor_id, ROUND(ATAN2(x, y), 6) + 0.0e0 AS bearing FROM v_sensors")
def bearing(t: Tables) -> DataFrame:
    return t.sensors.select("sensor_id", r(geo.bearing("x", "y")).alias("bearing"))


@query("angle_diff", """SELECT sensor_id, ROUND(CASE WHEN d > PI() THEN 2 * PI() - d ELSE d END, 6) + 0.0e0 AS diff FROM
  (SELECT sensor_id, ABS(RADIANS(heading_deg) - ATAN2(x, y)) % (2 * PI()) AS d FROM v_sensors WHERE heading_deg IS NOT NULL) q""")
def angle_diff(t: Tables) -> DataFrame:
    return t.sensors.where("heading_deg IS NOT NULL").select("sensor_id", r(geo.angle_diff(F.radians("heading_deg"), geo.bearing("x", "y"))).alias("diff"))


SEG = "SELECT sensor_id, x AS px, y AS py, x / 2.0e0 - 100.0e0 AS ax, y / 3.0e0 AS ay, x / 2.0e0 + 150.0e0 AS bx, y / 3.0e0 + 80.0e0 AS by_ FROM v_sensors"


@query("point_segment_distance", f"""SELECT sensor_id, ROUND(SQRT((px - ax - tt * (bx - ax)) ** 2 + (py - ay - tt * (by_ - ay)) ** 2), 6) AS d FROM
  (SELECT *, GREATEST(0.0e0, LEAST(1.0e0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) AS tt FROM ({SEG}) s) q""")
def point_segment_distance(t: Tables) -> DataFrame:
    return t.sql(SEG).select("sensor_id", F.round(geo.point_segment_distance("px", "py", "ax", "ay", "bx", "by_"), 6).alias("d"))


@query("perp_line_distance", f"""SELECT sensor_id, ROUND(ABS((bx - ax) * (ay - py) - (by_ - ay) * (ax - px)) / SQRT((bx - ax) ** 2 + (by_ - ay) ** 2), 6) AS d FROM ({SEG}) s""")
def perp_line_distance(t: Tables) -> DataFrame:
    return t.sql(SEG).select("sensor_id", F.round(geo.perp_line_distance("px", "py", "ax", "ay", "bx", "by_"), 6).alias("d"))


SEGMENTS = """SELECT route_id, seq, x AS x0, y AS y0, LEAD(x) OVER (PARTITION BY route_id ORDER BY seq) AS x1, LEAD(y) OVER (PARTITION BY route_id ORDER BY seq) AS y1 FROM v_route_points"""
T = "GREATEST(0.0e0, LEAST(1.0e0, ((0.0e0 - x0) * (x1 - x0) + (0.0e0 - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2)))"


def _polylines(t: Tables) -> DataFrame:
    return geometry.rings(t.route_points, "route_id", "seq").withColumnRenamed("ring", "points")


@query("polyline_distance2", f"""SELECT route_id, ROUND(MIN((x0 + tt * (x1 - x0)) ** 2 + (y0 + tt * (y1 - y0)) ** 2), 4) AS d2 FROM
  (SELECT *, {T} AS tt FROM ({SEGMENTS}) s WHERE x1 IS NOT NULL) q GROUP BY route_id""")
def polyline_distance2(t: Tables) -> DataFrame:
    from kerbside.operators.sequence import segments

    d = geo.point_segment_distance(0.0, 0.0, "x0", "y0", "x1", "y1")
    return segments(t.route_points, "route_id").groupBy("route_id").agg(F.round(F.min(d * d), 4).alias("d2"))


RING_EDGES = """SELECT zone_id, seq, x AS x1, y AS y1, COALESCE(LAG(x) OVER (PARTITION BY zone_id ORDER BY seq), LAST_VALUE(x) OVER (PARTITION BY zone_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS x0,
  COALESCE(LAG(y) OVER (PARTITION BY zone_id ORDER BY seq), LAST_VALUE(y) OVER (PARTITION BY zone_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS y0 FROM v_ring_points"""


@query("nearest_on_ring", f"""SELECT zone_id, ROUND(x0 + tt * (x1 - x0), 4) + 0.0e0 AS qx, ROUND(y0 + tt * (y1 - y0), 4) + 0.0e0 AS qy FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY zone_id ORDER BY ROUND((x0 + tt * (x1 - x0)) ** 2 + (y0 + tt * (y1 - y0)) ** 2, 6), seq) AS rn FROM
  (SELECT *, {T} AS tt FROM ({RING_EDGES}) e) q) w WHERE rn = 1""")
def nearest_on_ring(t: Tables) -> DataFrame:
    ring = F.col("ring")
    n = F.size(ring)

    def foot(i: Column) -> Column:
        a, b = ring[F.when(i == 0, n - 1).otherwise(i - 1)], ring[i]
        s = geo.along(0.0, 0.0, a.x, a.y, b.x, b.y)
        x, y = geo.lerp(a.x, b.x, s), geo.lerp(a.y, b.y, s)
        return F.struct(F.round(x * x + y * y, 6).alias("d2"), i.alias("i"), x.alias("x"), y.alias("y"))

    best = F.array_min(F.transform(F.sequence(F.lit(0), n - 1), foot))
    return t.zone_rings.withColumn("best", best).select("zone_id", r(F.col("best.x"), 4).alias("qx"), r(F.col("best.y"), 4).alias("qy"))


@query("point_in_ring", f"""SELECT s.sensor_id, e.zone_id FROM v_sensors s JOIN ({RING_EDGES}) e ON (e.y1 > s.y) <> (e.y0 > s.y) AND s.x < (e.x0 - e.x1) * (s.y - e.y1) / (e.y0 - e.y1) + e.x1
  GROUP BY s.sensor_id, e.zone_id HAVING COUNT(*) % 2 = 1""")
def point_in_ring(t: Tables) -> DataFrame:
    return spatial.in_polygons(t.sensors, t.zone_rings, 200.0).select("sensor_id", "zone_id")


@query("bbox_prefilter", """SELECT s.sensor_id, z.zone_id FROM v_sensors s JOIN v_zones z ON s.x BETWEEN z.minx AND z.maxx AND s.y BETWEEN z.miny AND z.maxy""")
def bbox_prefilter(t: Tables) -> DataFrame:
    boxed = spatial.dealt_box(t.zones, "minx", "miny", "maxx", "maxy", 400.0)
    return spatial.cell_join(spatial.dealt_point(t.sensors, "x", "y", 400.0), boxed, geo.in_bbox("x", "y", "minx", "miny", "maxx", "maxy")).select("sensor_id", "zone_id")


@query("ring_bbox", "SELECT zone_id, MIN(x) AS minx, MIN(y) AS miny, MAX(x) AS maxx, MAX(y) AS maxy FROM v_ring_points GROUP BY zone_id")
def ring_bbox(t: Tables) -> DataFrame:
    return t.zone_rings.select("zone_id", "minx", "miny", "maxx", "maxy")


@query("ring_area", f"SELECT zone_id, ROUND(ABS(SUM(x0 * y1 - x1 * y0)) / 2, 4) AS area, ROUND(ABS(SUM(x0 * y1 - x1 * y0)), 4) AS area2 FROM ({RING_EDGES}) e GROUP BY zone_id")
def ring_area(t: Tables) -> DataFrame:
    return t.zone_rings.select("zone_id", F.round(geo.ring_area("ring"), 4).alias("area"), F.round(F.abs(geo.ring_area2("ring")), 4).alias("area2"))


@query("ring_centroid", f"""SELECT zone_id, ROUND(SUM((x0 + x1) * (x0 * y1 - x1 * y0)) / (3 * SUM(x0 * y1 - x1 * y0)), 4) + 0.0e0 AS cx,
  ROUND(SUM((y0 + y1) * (x0 * y1 - x1 * y0)) / (3 * SUM(x0 * y1 - x1 * y0)), 4) + 0.0e0 AS cy FROM ({RING_EDGES}) e GROUP BY zone_id""")
def ring_centroid(t: Tables) -> DataFrame:
    cx, cy = geo.ring_centroid("ring")
    return t.zone_rings.select("zone_id", r(cx, 4).alias("cx"), r(cy, 4).alias("cy"))


@query("vertex_mean", "SELECT zone_id, ROUND(AVG(x), 6) + 0.0e0 AS mx, ROUND(AVG(y), 6) + 0.0e0 AS my FROM v_ring_points GROUP BY zone_id")
def vertex_mean(t: Tables) -> DataFrame:
    mx, my = geo.vertex_mean("ring")
    return t.zone_rings.select("zone_id", r(mx).alias("mx"), r(my).alias("my"))


@query("landmark_anchor", """SELECT route_id, ROUND(COALESCE(AVG(CASE WHEN h < 2.0e0 THEN x END), AVG(x)), 6) + 0.0e0 AS ax, ROUND(COALESCE(AVG(CASE WHEN h < 2.0e0 THEN y END), AVG(y)), 6) + 0.0e0 AS ay FROM
  (SELECT *, CAST((route_id * 5 + seq * 3) % 7 AS DOUBLE) AS h FROM v_route_points WHERE route_id % 4 <> 3 OR (route_id * 5 + seq * 3) % 7 >= 2) q GROUP BY route_id""")
def landmark_anchor(t: Tables) -> DataFrame:
    low = lambda c: F.coalesce(F.avg(F.when(F.col("h") < 2.0, F.col(c))), F.avg(c))
    verts = t.route_points.withColumn("h", F.expr("CAST((route_id * 5 + seq * 3) % 7 AS DOUBLE)")).where("route_id % 4 <> 3 OR h >= 2")
    return verts.groupBy("route_id").agg(r(low("x")).alias("ax"), r(low("y")).alias("ay"))


@query("wedge_from_degrees", "SELECT sensor_id, ROUND(CASE WHEN heading_deg IS NULL THEN PI() ELSE RADIANS(full_fov_deg) / 2 END, 6) AS half_fov, ROUND(RADIANS(heading_deg), 6) AS heading FROM v_sensors")
def wedge_from_degrees(t: Tables) -> DataFrame:
    return spatial.placed(t.sensors).select("sensor_id", F.round("half_fov_rad", 6).alias("half_fov"), F.round("heading_rad", 6).alias("heading"))


NEAR = "s.x + (s.sensor_id * 31 % 41) - 20.0e0 AS px, s.y + (s.sensor_id * 17 % 37) - 18.0e0 AS py"
COVERED = """SQRT((px - x) ** 2 + (py - y) ** 2) <= range_m AND (heading_deg IS NULL OR (px = x AND py = y) OR
  (CASE WHEN ABS(RADIANS(heading_deg) - ATAN2(px - x, py - y)) % (2 * PI()) > PI() THEN 2 * PI() - ABS(RADIANS(heading_deg) - ATAN2(px - x, py - y)) % (2 * PI())
   ELSE ABS(RADIANS(heading_deg) - ATAN2(px - x, py - y)) % (2 * PI()) END) <= RADIANS(full_fov_deg) / 2)"""


@query("covers_unoccluded", f"SELECT sensor_id, {COVERED} AS covered FROM (SELECT s.*, {NEAR} FROM v_sensors s) q")
def covers_unoccluded(t: Tables) -> DataFrame:
    near = spatial.placed(t.sql(f"SELECT s.*, {NEAR} FROM v_sensors s"))
    return near.select("sensor_id", geo.covers("px", "py", "ax", "ay", "heading_rad", "half_fov_rad", "range_m").alias("covered"))


CROSS = "SELECT sensor_id, x AS ax, y AS ay, x + 50.0e0 AS bx, y + 20.0e0 AS by_, x + (sensor_id * 13 % 60) AS cx, y - 10.0e0 AS cy, x + (sensor_id * 29 % 60) AS dx, y + 40.0e0 AS dy FROM v_sensors"
SIDES = "((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) * ((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) < 0 AND ((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * ((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) < 0"


@query("segments_cross", f"SELECT sensor_id, {SIDES} AS crosses FROM ({CROSS}) q")
def segments_cross(t: Tables) -> DataFrame:
    return t.sql(CROSS).select("sensor_id", geo.segments_cross("ax", "ay", "bx", "by_", "cx", "cy", "dx", "dy").alias("crosses"))


WALLS = "SELECT facility_id AS wall_id, x - 8.0e0 AS wx0, y - 3.0e0 AS wy0, x + 9.0e0 AS wx1, y + 4.0e0 AS wy1 FROM v_facilities"
SIGHT = f"SELECT sensor_id, heading_deg, full_fov_deg, range_m, x, y, px, py FROM (SELECT s.*, {NEAR} FROM v_sensors s) q"
WALL_CROSS = SIDES.replace("bx", "px").replace("by_", "py").replace("ax", "x").replace("ay", "y").replace("cx", "wx0").replace("cy", "wy0").replace("dx", "wx1").replace("dy", "wy1")


@query("sightline_blocked", f"SELECT DISTINCT sensor_id FROM ({SIGHT}) s JOIN ({WALLS}) w ON {WALL_CROSS}")
def sightline_blocked(t: Tables) -> DataFrame:
    seen = t.sql(SIGHT).withColumnsRenamed({"x": "ax", "y": "ay"})
    return seen.select("sensor_id").join(spatial.unblocked(seen, t.sql(WALLS), 60.0, ("sensor_id",)).select("sensor_id"), "sensor_id", "left_anti")


@query("captures", f"SELECT sensor_id FROM ({SIGHT}) s WHERE {COVERED} AND NOT EXISTS (SELECT 1 FROM ({WALLS}) w WHERE {WALL_CROSS})")
def captures(t: Tables) -> DataFrame:
    seen = spatial.placed(t.sql(SIGHT)).where(geo.covers("px", "py", "ax", "ay", "heading_rad", "half_fov_rad", "range_m"))
    return spatial.unblocked(seen, t.sql(WALLS), 60.0, ("sensor_id",)).select("sensor_id")


DIM = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{a}' AS tier, '{b}' AS label, {str(c).upper()} AS is_fixed, {str(d).upper()} AS recall_corrected, {'NULL' if e is None else repr(e)} AS attestation" for k, a, b, c, d, e in scalar.SOURCES)


@query("source_dim", f"SELECT kind, tier, label, is_fixed, recall_corrected FROM ({DIM}) d")
def source_dim(t: Tables) -> DataFrame:
    return scalar.source_dim(t.spark).drop("attestation")


@query("p_at_least_one", f"SELECT {K}, ROUND(1 - EXP(-(c_custkey % 50) / 10.0e0), 8) AS p FROM customer")
def p_at_least_one(t: Tables) -> DataFrame:
    return t.sql(f"SELECT {K}, (c_custkey % 50) / 10.0e0 AS mean FROM customer").select("id", F.round(scalar.p_at_least_one("mean"), 8).alias("p"))


HOUR = "SELECT CAST(o_orderkey AS BIGINT) AS id, (o_orderkey * 7 % 2000) / 40.0e0 - 12.0e0 AS hour FROM orders"
H24 = "(hour - FLOOR(hour / 24.0e0) * 24.0e0)"


@query("headway_step", f"SELECT id, CASE WHEN ({H24} >= 7 AND {H24} < 9) OR ({H24} >= 16 AND {H24} < 19) THEN 5.0e0 WHEN {H24} >= 6 AND {H24} < 22 THEN 10.0e0 ELSE 25.0e0 END AS headway FROM ({HOUR}) q")
def headway_step(t: Tables) -> DataFrame:
    return t.sql(HOUR).select("id", scalar.headway_step("hour").alias("headway"))


def curve_sql(h: str, floor: float, am: float, pm: float) -> str:
    bell = lambda m, w: f"EXP(-((({h} - {m}e0) / {w}e0) ** 2))"
    return f"({floor}e0 + {1 - floor}e0 * GREATEST({bell(am, 2.6)}, {bell(pm, 2.8)}, 0.55e0 * {bell(13.0, 4.0)}))"


@query("diurnal_curve", f"SELECT id, ROUND({curve_sql(H24, 0.12, 8.5, 17.5)}, 8) AS traffic, ROUND({curve_sql(H24, 0.10, 9.0, 18.0)}, 8) AS ped, ROUND({curve_sql(H24, 0.05, 12.0, 18.5)}, 8) AS robot FROM ({HOUR}) q")
def diurnal_curve(t: Tables) -> DataFrame:
    return t.sql(HOUR).select("id", F.round(scalar.traffic("hour"), 8).alias("traffic"), F.round(scalar.pedestrians("hour"), 8).alias("ped"), F.round(scalar.robots("hour"), 8).alias("robot"))


@query("minute_lookup", f"""SELECT id, ROUND(COALESCE(v.mult, {curve_sql(H24, 0.12, 8.5, 17.5)}), 8) AS mult FROM ({HOUR}) q LEFT JOIN
  (SELECT pu_min AS minute, COUNT(*) / 100.0e0 AS mult FROM v_trips GROUP BY pu_min) v ON v.minute = CAST(FLOOR({H24} * 60) AS BIGINT) % 1440""")
def minute_lookup(t: Tables) -> DataFrame:
    table = t.trips.groupBy(F.col("pu_min").alias("minute")).agg((F.count("*") / 100.0).alias("mult"))
    hours = t.sql(HOUR).withColumn("minute", F.floor(scalar.hour24("hour") * 60).cast("long") % 1440)
    return hours.join(table, "minute", "left").select("id", F.round(F.coalesce("mult", scalar.traffic("hour")), 8).alias("mult"))


PACKED = "SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 15 AS BIGINT) WHEN p_partkey % 11 = 0 THEN CAST(p_partkey % 85 + 15 AS BIGINT) ELSE CAST((p_partkey % 14 + 1) * 100 + p_partkey % 80 AS BIGINT) END AS packed FROM part"
CLS = "CASE WHEN packed BETWEEN 0 AND 14 THEN packed WHEN packed >= 100 THEN CAST(FLOOR(packed / 100.0e0) AS BIGINT) ELSE 0 END"
MPH = "CASE WHEN packed >= 100 THEN packed % 100 ELSE 0 END"


@query("unpack_class", f"SELECT id, CAST({CLS} AS BIGINT) AS road_class, CAST({MPH} AS BIGINT) AS mph FROM ({PACKED}) q")
def unpack_class(t: Tables) -> DataFrame:
    c, mph = scalar.unpack_class("packed")
    return t.sql(PACKED).select("id", c.alias("road_class"), mph.alias("mph"))


@query("class_speed", f"""SELECT id, ROUND(LEAST(CASE WHEN mph > 0 THEN mph * 1.0e0 WHEN c = 2 THEN 40.0e0 WHEN c = 9 OR c = 3 THEN 30.0e0 WHEN c = 4 THEN 35.0e0 ELSE 25.0e0 END, 60.0e0) * 0.44704e0, 6) AS speed
  FROM (SELECT id, {CLS} AS c, {MPH} AS mph FROM ({PACKED}) q) w""")
def class_speed(t: Tables) -> DataFrame:
    return t.sql(PACKED).select("id", F.round(scalar.class_speed(*scalar.unpack_class("packed")), 6).alias("speed"))


GTFS = "SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'bad' ELSE CONCAT(CAST(o_orderkey % 30 AS VARCHAR(9)), ':', CAST(o_orderkey % 60 AS VARCHAR(9)), CASE WHEN o_orderkey % 2 = 0 THEN ':30' ELSE '' END) END AS t FROM orders"


@query("gtfs_minutes", "SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 30) * 60.0e0 + o_orderkey % 60 + CASE WHEN o_orderkey % 2 = 0 THEN 0.5e0 ELSE 0.0e0 END END AS minutes FROM orders")
def gtfs_minutes(t: Tables) -> DataFrame:
    return t.sql(GTFS).select("id", scalar.gtfs_minutes("t").alias("minutes"))


@query("weekday_sakamoto", "SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(EXTRACT(DOW FROM o_orderdate) AS BIGINT) AS weekday FROM orders")
def weekday_sakamoto(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").cast("long").alias("id"), scalar.weekday_from_sunday("o_orderdate").alias("weekday"))


NAMES = "SELECT CAST(s_suppkey AS BIGINT) AS id, CASE s_suppkey % 5 WHEN 0 THEN CONCAT('m', CAST(s_suppkey % 40 AS VARCHAR(9)), 'A-SBS') WHEN 1 THEN CONCAT('Bx', CAST(s_suppkey AS VARCHAR(9))) WHEN 2 THEN 'SIM' WHEN 3 THEN '42' ELSE s_name END AS name FROM supplier"


@query("route_base", f"""SELECT id, NULLIF(UPPER(REGEXP_EXTRACT(name, '^([A-Za-z]+[0-9]+)', 1)), '') AS base,
  CASE WHEN REGEXP_EXTRACT(UPPER(name), '^([A-Z]+)[0-9]', 1) = 'M' THEN UPPER(REGEXP_EXTRACT(name, '^([A-Za-z]+[0-9]+)', 1)) END AS base_m FROM ({NAMES}) q""")
def route_base(t: Tables) -> DataFrame:
    return t.sql(NAMES).select("id", scalar.route_base("name").alias("base"), scalar.route_base("name", True).alias("base_m"))


@query("extent_filter", f"SELECT id FROM (SELECT {K}, {LATLON} FROM customer) q WHERE lat BETWEEN 40.698e0 AND 40.882e0 AND lon BETWEEN -74.022e0 AND -73.906e0")
def extent_filter(t: Tables) -> DataFrame:
    return _latlon(t).where(scalar.in_extent("lat", "lon", "borough")).select("id")


BORO = "SELECT CAST(c_custkey AS BIGINT) AS id, CASE c_custkey % 6 WHEN 0 THEN 'Staten Island' WHEN 1 THEN 'MANHATTAN' WHEN 2 THEN 'queens' WHEN 3 THEN 'Staten_Island' WHEN 4 THEN 'The-Bronx' ELSE 'bronx' END AS boro, CAST(c_custkey % 5 + 1 AS BIGINT) * 1000000 + c_custkey AS bin FROM customer"


@query("borough_code", f"""SELECT id, CAST(CASE LOWER(REGEXP_REPLACE(boro, '[ _-]', '', 'g')) WHEN 'manhattan' THEN 1 WHEN 'bronx' THEN 2 WHEN 'brooklyn' THEN 3 WHEN 'queens' THEN 4 WHEN 'statenisland' THEN 5 END AS BIGINT) AS code,
  CAST(FLOOR(bin / 1000000) AS BIGINT) AS digit FROM ({BORO}) q""")
def borough_code(t: Tables) -> DataFrame:
    return t.sql(BORO).select("id", scalar.borough_code("boro").alias("code"), bin_digit("bin").alias("digit"))


def bin_digit(number) -> Column:
    """The first digit of a building number, which is its borough."""
    return F.left(geo.col(number).cast("string"), F.lit(1)).cast("long")


@query("bin_digit", f"SELECT id, CAST(SUBSTR(CAST(bin AS VARCHAR), 1, 1) AS BIGINT) AS digit, CAST(SUBSTR(CAST(bin AS VARCHAR), 1, 1) AS BIGINT) = 1 AS kept FROM ({BORO}) q")
def bin_digits(t: Tables) -> DataFrame:
    return t.sql(BORO).select("id", bin_digit("bin").alias("digit"), (bin_digit("bin") == 1).alias("kept"))


@query("normalize_name", "SELECT CAST(p_partkey AS BIGINT) AS id, LOWER(REGEXP_REPLACE(p_name, '[^A-Za-z0-9]', '', 'g')) AS name FROM part")
def normalize_name(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").cast("long").alias("id"), scalar.normalize_name("p_name").alias("name"))


MADE = "SELECT CAST(s_suppkey AS BIGINT) AS id, CASE s_suppkey % 9 WHEN 0 THEN 'Flock Safety' WHEN 1 THEN 'ELSAG' WHEN 2 THEN 'AutoVu' WHEN 3 THEN 'Vigilant Solutions' WHEN 4 THEN NULL WHEN 5 THEN 'RedSpeed' WHEN 6 THEN 'Neology' WHEN 7 THEN 'EKIN' ELSE s_name END AS made FROM supplier"


@query("maker_classify", f"""SELECT id, CASE WHEN m LIKE '%flock%' THEN 'Flock' WHEN m LIKE '%leonardo%' OR m LIKE '%elsag%' THEN 'Leonardo' WHEN m LIKE '%redspeed%' THEN 'Redspeed' WHEN m LIKE '%ekin%' THEN 'Ekin'
  WHEN m LIKE '%mav%' THEN 'Mav' WHEN m LIKE '%genetec%' OR m LIKE '%autovu%' THEN 'Genetec' WHEN m LIKE '%motorola%' OR m LIKE '%vigilant%' OR m LIKE '%neology%' THEN 'Motorola' ELSE 'Other' END AS maker FROM (SELECT id, LOWER(made) AS m FROM ({MADE}) q) w""")
def maker_classify(t: Tables) -> DataFrame:
    return t.sql(MADE).select("id", scalar.maker("made").alias("maker"))


FAC = "SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 3 WHEN 0 THEN ' Schools (K-12)' WHEN 1 THEN 'LIBRARIES' ELSE 'PARKS' END AS grp FROM part"


@query("facility_classify", "SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 3 WHEN 0 THEN 'School' ELSE 'Library' END AS kind FROM part WHERE p_partkey % 3 < 2")
def facility_classify(t: Tables) -> DataFrame:
    return t.sql(FAC).select("id", scalar.facility_kind("grp").alias("kind")).where("kind IS NOT NULL")


@query("sign_subtype", "SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 3 WHEN 0 THEN 'redlight' WHEN 1 THEN 'bus' ELSE 'speed' END AS subtype FROM part")
def sign_subtype(t: Tables) -> DataFrame:
    text = "CASE p_partkey % 3 WHEN 0 THEN 'Red Light photo' WHEN 1 THEN 'BUS lane' ELSE 'photo enforced' END"
    return t.part.select(F.col("p_partkey").cast("long").alias("id"), scalar.sign_subtype(F.expr(text)).alias("subtype"))


HIGHWAYS = ("primary", "secondary", "residential", "footway")


@query("highway_keep", """SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % 5 < 4 AS keep, o_orderkey % 7 = 1 OR (o_orderkey % 7 <> 2 AND o_orderkey % 5 < 3 AND o_orderkey % 3 <> 0) AS drive FROM orders""")
def highway_keep(t: Tables) -> DataFrame:
    return tagged_ways(t).select("id", F.col("tags")["highway"].isin(*HIGHWAYS).alias("keep"), drive_allowed("tags").alias("drive"))


@query("drive_allowed", """SELECT highway, access, motor, COUNT(*) AS ways, motor = 'yes' OR (motor <> 'no' AND highway IN ('primary', 'secondary', 'residential') AND access <> 'private') AS drive FROM (
  SELECT CASE o_orderkey % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'residential' WHEN 3 THEN 'footway' ELSE 'proposed' END AS highway,
    CASE WHEN o_orderkey % 3 = 0 THEN 'private' ELSE 'yes' END AS access, CASE o_orderkey % 7 WHEN 1 THEN 'yes' WHEN 2 THEN 'no' ELSE '' END AS motor FROM orders) q GROUP BY 1, 2, 3""")
def drive_by_tags(t: Tables) -> DataFrame:
    ways = tagged_ways(t).select(F.col("tags")["highway"].alias("highway"), F.col("tags")["access"].alias("access"), F.col("tags")["motor_vehicle"].alias("motor"), drive_allowed("tags").alias("drive"))
    return ways.groupBy("highway", "access", "motor", "drive").agg(F.count("*").alias("ways"))


def drive_allowed(tags) -> Column:
    """Whether cars may use a way: by its own tag for motor vehicles, else by its kind and access."""
    t = geo.col(tags)
    motor = t["motor_vehicle"]
    return (motor == "yes") | ((motor != "no") & t["highway"].isin(*HIGHWAYS[:3]) & ~t["access"].isin("private", "no"))


def tagged_ways(t: Tables) -> DataFrame:
    tags = F.create_map(
        F.lit("highway"), F.element_at(F.array(*map(F.lit, (*HIGHWAYS, "proposed"))), (F.col("o_orderkey") % 5 + 1).cast("int")),
        F.lit("access"), F.when(F.col("o_orderkey") % 3 == 0, "private").otherwise("yes"),
        F.lit("motor_vehicle"), F.when(F.col("o_orderkey") % 7 == 1, "yes").when(F.col("o_orderkey") % 7 == 2, "no").otherwise(""),
    )
    return t.orders.select(F.col("o_orderkey").cast("long").alias("id"), tags.alias("tags"))


@query("alpr_heading", "SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey * 53 % 360 AS DOUBLE) END AS heading FROM supplier")
def alpr_heading(t: Tables) -> DataFrame:
    text = "CASE s_suppkey % 4 WHEN 0 THEN 'N;S' WHEN 1 THEN concat(s_suppkey * 53 % 360, '; 209') WHEN 2 THEN concat('NE; ', s_suppkey * 53 % 360) ELSE CAST(s_suppkey * 53 % 360 AS STRING) END"
    return t.supplier.select(F.col("s_suppkey").cast("long").alias("id"), scalar.first_number(F.expr(text)).alias("heading"))


@query("nonempty_tag", "SELECT CAST(s_suppkey AS BIGINT) AS id, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'op' END AS tag FROM supplier")
def nonempty_tag(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").cast("long").alias("id"), scalar.nonempty(F.expr("CASE WHEN s_suppkey % 3 = 0 THEN concat(' ', s_name) ELSE '  ' END"), F.expr("CASE WHEN s_suppkey % 3 = 1 THEN 'op ' END")).alias("tag"))


@query("attestation_label", f"SELECT s.sensor_id, d.attestation AS label FROM v_sensors s LEFT JOIN ({DIM}) d ON d.kind = s.kind")
def attestation_label(t: Tables) -> DataFrame:
    return t.sensors.join(scalar.source_dim(t.spark), "kind", "left").select("sensor_id", F.col("attestation").alias("label"))


@query("fmt_thousands", "SELECT CAST(o_orderkey AS BIGINT) AS id, FORMAT('{:,}', CAST(o_orderkey * 977 AS BIGINT)) AS txt FROM orders")
def fmt_thousands(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").cast("long").alias("id"), scalar.thousands(F.col("o_orderkey") * 977).alias("txt"))


@query("fmt_usd", "SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN v >= 1000000 THEN PRINTF('$%.1fM', v / 1000000.0e0) WHEN v >= 1000 THEN PRINTF('$%.0fK', v / 1000.0e0) ELSE PRINTF('$%.0f', v) END AS txt FROM (SELECT o_orderkey, CAST((o_orderkey * 977 % 9000) * 10000 + 1300 AS DOUBLE) AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, CAST(o_orderkey % 900 AS DOUBLE) FROM orders WHERE o_orderkey % 2 = 1) q")
def fmt_usd(t: Tables) -> DataFrame:
    v = F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") * 977 % 9000) * 10000 + 1300).otherwise(F.col("o_orderkey") % 900).cast("double")
    return t.orders.select(F.col("o_orderkey").cast("long").alias("id"), scalar.usd(v).alias("txt"))


@query("heat_norm", "SELECT zone_id, ROUND(n / MAX(n) OVER (), 8) AS heat, ROUND(GREATEST(0.0e0, LEAST(1.0e0, LN(1 + n) / LN(76.0e0))), 8) AS coverage FROM (SELECT pu_zone AS zone_id, CAST(COUNT(*) AS DOUBLE) AS n FROM v_trips GROUP BY pu_zone) q")
def heat_norm(t: Tables) -> DataFrame:
    n = t.trips.groupBy(F.col("pu_zone").alias("zone_id")).agg(F.count("*").cast("double").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("top")))).select("zone_id", F.round(F.col("n") / F.col("top"), 8).alias("heat"), F.round(scalar.coverage_norm("n"), 8).alias("coverage"))


@query("coverage_norm", "SELECT k AS covered, ROUND(GREATEST(0.0e0, LEAST(1.0e0, LN(1 + k) / LN(76.0e0))), 8) AS shade FROM (SELECT DISTINCT CAST(o_orderkey % 120 AS DOUBLE) AS k FROM orders) q")
def coverage_shade(t: Tables) -> DataFrame:
    k = t.orders.select(F.expr("CAST(o_orderkey % 120 AS DOUBLE)").alias("covered")).distinct()
    return k.select("covered", F.round(scalar.coverage_norm("covered"), 8).alias("shade"))


@query("ellipsize", "SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN LENGTH(p_name) > 12 THEN CONCAT(LEFT(p_name, 11), '…') ELSE p_name END AS txt FROM part")
def ellipsize(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").cast("long").alias("id"), scalar.ellipsize("p_name", 12).alias("txt"))


@query("percent_encode", "SELECT CAST(p_partkey AS BIGINT) AS id, REPLACE(CONCAT(REPLACE(p_name, '#', '%23'), ' & ~*'), ' & ~*', '%20%26%20~%2A') AS txt FROM (SELECT p_partkey, REPLACE(p_name, ' ', '%20') AS p_name FROM part) q")
def percent_encode(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").cast("long").alias("id"), scalar.percent_encode(F.concat("p_name", F.lit(" & ~*"))).alias("txt"))


GEOCODE = "array<struct<properties:struct<label:string>,geometry:struct<coordinates:array<double>>>>"


@query("geocode_parse", """SELECT label, lat, lon FROM (SELECT c_name AS label, lat, lon, ROW_NUMBER() OVER (ORDER BY id) AS rn FROM (SELECT CAST(c_custkey AS BIGINT) AS id, c_name, """ + LATLON + """ FROM customer WHERE c_custkey <= 200) q
  WHERE lat BETWEEN 40.698e0 AND 40.882e0 AND lon BETWEEN -74.022e0 AND -73.906e0) w WHERE rn <= 6""")
def geocode_parse(t: Tables) -> DataFrame:
    found = t.sql(f"SELECT {K}, c_name, {LATLON} FROM customer WHERE c_custkey <= 200")
    feature = F.struct(F.struct(F.col("c_name").alias("label")).alias("properties"), F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"))
    answer = found.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("id", feature.alias("f")))), lambda s: s.f).alias("features"))).alias("body"))
    return parse_geocode(answer, "borough")


def parse_geocode(answers: DataFrame, extent: str) -> DataFrame:
    """answers(body): the first six features inside the extent."""
    rows = answers.select(F.posexplode(F.from_json("body", f"struct<features:{GEOCODE}>").getField("features")).alias("i", "f"))
    rows = rows.select("i", F.col("f.properties.label").alias("label"), F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"))
    return rows.where(scalar.in_extent("lat", "lon", extent)).orderBy("i").limit(6).select("label", "lat", "lon")


MAX_ENTROPY = math.log(5)
