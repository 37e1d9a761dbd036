"""Derived views over the test tables, in SQL that Spark and DuckDB both run. World: 2 km square around (0, 0), metres."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks".split()

TRIP_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
TRIP_NUMBER = f"CAST(ROW_NUMBER() OVER (ORDER BY {', '.join(TRIP_ORDER)}) AS BIGINT) AS trip_id"

VIEWS = {
    "v_sensors": """SELECT CAST(c_custkey AS BIGINT) AS sensor_id, 'FixedCctv' AS kind,
       (c_custkey * 7919 % 20000) / 10.0e0 - 1000.0e0 AS x, (c_custkey * 104729 % 20000) / 10.0e0 - 1000.0e0 AS y,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey * 37 % 360 AS DOUBLE) END AS heading_deg,
       70.0e0 AS full_fov_deg, 15.0e0 AS range_m, 15.0e0 AS frame_rate FROM customer
UNION ALL
SELECT 1000000 + s_suppkey, 'Alpr', (s_suppkey * 3 * 7919 % 20000) / 10.0e0 - 995.0e0,
       (s_suppkey * 3 * 104729 % 20000) / 10.0e0 - 1000.0e0, CAST(s_suppkey * 53 % 360 AS DOUBLE), 70.0e0, 15.0e0, 15.0e0 FROM supplier
UNION ALL
SELECT 2000000 + p_partkey, 'DotLiveView', (p_partkey * 7919 % 20000) / 10.0e0 - 992.0e0,
       (p_partkey * 104729 % 20000) / 10.0e0 - 1006.0e0, NULL, 360.0e0, 30.0e0, 1.0e0 FROM part WHERE p_partkey % 7 = 0""",
    "v_nodes": """SELECT CAST(o_orderkey AS BIGINT) AS node_id, (o_orderkey % 21 - 10) * 100.0e0 AS x,
       (CAST(FLOOR(o_orderkey / 21.0e0) AS BIGINT) - 10) * 100.0e0 AS y FROM orders WHERE o_orderkey < 441""",
    "v_edges": """SELECT node_id * 2 AS edge_id, node_id AS from_id, node_id + 1 AS to_id, x AS x0, y AS y0, x + 100.0e0 AS x1, y AS y1,
       100.0e0 AS length_m FROM v_nodes WHERE node_id % 21 < 20
UNION ALL
SELECT node_id * 2 + 1, node_id, node_id + 21, x, y, x, y + 100.0e0, 100.0e0 FROM v_nodes WHERE node_id < 420""",
    # a street grid that grows with the orders
    "v_street_nodes": """SELECT CAST(o_orderkey AS BIGINT) AS node_id, side, (o_orderkey % side) * 100.0e0 AS x, CAST(FLOOR(o_orderkey / (side * 1.0e0)) AS BIGINT) * 100.0e0 AS y
FROM orders CROSS JOIN (SELECT CAST(FLOOR(SQRT(COUNT(*))) AS BIGINT) AS side FROM orders) s WHERE o_orderkey < side * side""",
    "v_street_edges": """SELECT node_id * 2 AS edge_id, node_id AS from_id, node_id + 1 AS to_id, 100.0e0 AS length_m FROM v_street_nodes WHERE node_id % side < side - 1
UNION ALL
SELECT node_id * 2 + 1, node_id, node_id + side, 100.0e0 FROM v_street_nodes WHERE node_id < side * (side - 1)""",
    "v_zones": """SELECT CAST(n_nationkey AS BIGINT) AS zone_id, (n_nationkey % 5) * 400.0e0 - 1000.0e0 AS minx,
       CAST(FLOOR(n_nationkey / 5.0e0) AS BIGINT) * 400.0e0 - 1000.0e0 AS miny,
       (n_nationkey % 5) * 400.0e0 - 600.0e0 AS maxx, CAST(FLOOR(n_nationkey / 5.0e0) AS BIGINT) * 400.0e0 - 600.0e0 AS maxy FROM nation""",
    "v_trips": f"""SELECT {TRIP_NUMBER},
       (l_orderkey * 17 + l_linenumber * 61) % 1440 AS pu_min, CAST(c_nationkey AS BIGINT) AS pu_zone,
       CAST(s_nationkey AS BIGINT) AS do_zone, 1.0e0 + l_quantity * 0.5e0 AS dur_min,
       l_extendedprice / 10000.0e0 AS trip_miles
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
    "v_keyframes": """SELECT l_orderkey AS trip_id, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS seq,
       (l_orderkey * 7 % 1400) + 2.0e0 * ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS time_min,
       l_quantity * 10.0e0 AS stop_arc FROM lineitem""",
    "v_groups": """SELECT CAST(c_nationkey AS BIGINT) AS geoid, c_mktsegment AS grp, COUNT(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment""",
    "v_facilities": """SELECT CAST(p_partkey AS BIGINT) AS facility_id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'School' ELSE 'Library' END AS kind,
       (p_partkey * 6007 % 20000) / 10.0e0 - 1000.0e0 AS x, (p_partkey * 9973 % 20000) / 10.0e0 - 1000.0e0 AS y FROM part WHERE p_partkey % 5 = 0""",
    "v_pings": """SELECT event_id, ts, user_id AS agent_id, event_type,
       (event_id * 7919 % 20000) / 10.0e0 - 1000.0e0 AS x, (user_id * 104729 % 20000) / 10.0e0 - 1000.0e0 AS y FROM events""",
    # corners of an irregular hexagon for each nation
    "v_ring_points": """SELECT zone_id, seq, (minx + maxx) / 2.0e0 + dx * (100.0e0 + (zone_id * 37 + seq * 11) % 60) AS x,
       (miny + maxy) / 2.0e0 + dy * (100.0e0 + (zone_id * 37 + seq * 11) % 60) AS y
FROM v_zones CROSS JOIN (
  SELECT CAST(0 AS BIGINT) AS seq, 1.0e0 AS dx, 0.0e0 AS dy UNION ALL SELECT 1, 0.5e0, 0.75e0 UNION ALL SELECT 2, -0.5e0, 0.75e0 UNION ALL
  SELECT 3, -1.0e0, 0.0e0 UNION ALL SELECT 4, -0.5e0, -0.75e0 UNION ALL SELECT 5, 0.5e0, -0.75e0) d""",
    # a street-like polyline for each supplier
    "v_route_points": """SELECT CAST(s_suppkey AS BIGINT) AS route_id, seq, (s_suppkey * 7919 % 2000) / 1.0e0 - 1000.0e0 + seq * 40.0e0 AS x,
       (s_suppkey * 104729 % 2000) / 1.0e0 - 1000.0e0 + (s_suppkey * (seq + 3) * 13 % 50) / 1.0e0 AS y
FROM supplier CROSS JOIN (SELECT CAST(0 AS BIGINT) AS seq UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) q""",
    # recorded positions: an event's walker at its time of day
    "v_walk": """SELECT agent_id, event_id, EXTRACT(HOUR FROM ts) * 60 + EXTRACT(MINUTE FROM ts) AS minute, ts, x, y FROM v_pings""",
}


def with_views(sql: str, given: tuple[str, ...] = ()) -> str:
    """sql with the views that it names, but those given, and those that they name, as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if name in VIEWS and name not in order and name not in given:
                need(VIEWS[name])
                order.append(name)

    need(sql)
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    if not ctes:
        return sql
    if m := re.match(r"\s*WITH (RECURSIVE )?", sql):
        return f"WITH {m[1] or ''}{ctes}, {sql[m.end():]}"
    return f"WITH {ctes} {sql}"


class Tables:
    """The tables of one folder, and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if f"v_{name}" in VIEWS:
            return self.sql(f"SELECT * FROM v_{name}")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """text over views and tables, which are passed as arguments and not registered."""
        full = with_views(text, ("v_trips",))
        found = {t: self.table(t) for t in TABLES if re.search(rf"\b{t}\b", full)}
        if re.search(r"\bv_trips\b", full):
            found["v_trips"] = self.trips
        return self.spark.sql(re.sub(rf"(?<=FROM |JOIN )({'|'.join(found)})\b", r"{\1}", full), **found) if found else self.spark.sql(full)

    @cached_property
    def trips(self) -> DataFrame:
        """v_trips, numbered in two levels: the view's window over the whole table would be one task."""
        from kerbside.operators.sequence import prefix_over_buckets

        rows = self.sql(VIEWS["v_trips"].replace(TRIP_NUMBER, f"{', '.join(TRIP_ORDER)}, CAST(1 AS BIGINT) AS one"))
        numbered = prefix_over_buckets(rows, F.floor(F.col("l_orderkey") / 1024), TRIP_ORDER, "one", "trip_id")
        return numbered.select("trip_id", "pu_min", "pu_zone", "do_zone", "dur_min", "trip_miles")

    @cached_property
    def trip_rows(self) -> DataFrame:
        """v_trips without the numbers, for what needs none: nothing is sorted."""
        return self.sql(VIEWS["v_trips"].replace(f"{TRIP_NUMBER},\n", ""))

    @cached_property
    def zone_rings(self) -> DataFrame:
        from kerbside.operators.geometry import rings

        return rings(self.ring_points, "zone_id", "seq")
