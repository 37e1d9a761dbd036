"""Queries that call the SQL functions and the table function from spark.sql."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kerbside.functions import sqlfunctions

from .joins import RING_EDGES
from .registry import query
from .scalars import COVERED
from .sequences import STRETCH
from .views import Tables


@query("sql_functions", f"""SELECT sensor_id, ROUND(x, 4) + 0.0e0 AS x, ROUND(y, 4) + 0.0e0 AS y, COALESCE(i.held, FALSE) AS held, covered FROM
  (SELECT q.*, {COVERED} AS covered FROM (SELECT s.*, x + (sensor_id % 17 - 8) AS px, y + (sensor_id % 13 - 6) AS py FROM v_sensors s) q) c
  LEFT JOIN (SELECT s.sensor_id AS id, TRUE AS held FROM v_sensors s JOIN ({RING_EDGES}) e ON e.zone_id = s.sensor_id % 25 AND (e.y1 > s.y) <> (e.y0 > s.y) AND s.x < (e.x0 - e.x1) * (s.y - e.y1) / (e.y0 - e.y1) + e.x1
    GROUP BY s.sensor_id HAVING COUNT(*) % 2 = 1) i ON i.id = sensor_id""")
def sql_functions(t: Tables) -> DataFrame:
    """Projection there and back, a ring test and a capture test, all by registered functions."""
    sqlfunctions.register(t.spark)
    return t.spark.sql(
        """SELECT sensor_id, round(enu_x(enu_lon(x)), 4) + 0.0D AS x, round(enu_y(enu_lat(y)), 4) + 0.0D AS y, coalesce(point_in_ring(x, y, ring), false) AS held,
             captures(x + (sensor_id % 17 - 8), y + (sensor_id % 13 - 6), x, y, heading_deg, full_fov_deg, range_m) AS covered
           FROM {sensors} s LEFT JOIN {rings} r ON r.zone_id = s.sensor_id % 25""",
        sensors=t.sensors,
        rings=t.zone_rings,
    )


@query("udtf_sample_path", f"""SELECT route_id AS path, CAST(k AS BIGINT) AS k, ROUND(x0 + (x1 - x0) * (k * 25 - a0) / (a1 - a0), 6) + 0.0e0 AS x, ROUND(y0 + (y1 - y0) * (k * 25 - a0) / (a1 - a0), 6) + 0.0e0 AS y FROM ({STRETCH}) s
  JOIN (SELECT UNNEST(RANGE(0, 400)) AS k) i ON k * 25 >= a0 AND (k * 25 < a1 OR (a1 = total AND k * 25 <= a1)) WHERE a1 IS NOT NULL""")
def udtf_sample_path(t: Tables) -> DataFrame:
    """A point every 25 metres of each route, by a table function over a partitioned and ordered table."""
    sqlfunctions.register(t.spark)
    points = t.route_points.withColumnRenamed("route_id", "path")
    return t.spark.sql("SELECT path, k, round(x, 6) + 0.0D AS x, round(y, 6) + 0.0D AS y FROM sample_path(TABLE(SELECT * FROM {points}) PARTITION BY (path) ORDER BY (seq), 25.0D)", points=points)
