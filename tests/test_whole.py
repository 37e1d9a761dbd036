"""Queries that must take the whole of their tables."""

from __future__ import annotations

import collections
import re

import pytest

from kerbside.plans import catalog
from kerbside.plans.views import Tables, with_views

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_all_ways_are_split(spark):
    ways = collections.defaultdict(list)
    for r in Tables(spark, SF).sql("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem").collect():
        ways[r.l_orderkey].append((r.l_linenumber, r.l_partkey))
    uses = collections.Counter(n for w in ways.values() for _, n in w)
    want = collections.Counter()
    for way, nodes in ways.items():
        part = 0
        for k, (_, node) in enumerate(sorted(nodes)):
            want[way, part] += 1
            part += k > 0 and uses[node] > 1
    assert {(r.way, r.part): r.nodes for r in QUERIES["split_ways"](spark, SF).collect()} == want


def test_every_institution_is_ranked(spark):
    larger = SF.replace("0.001", "0.01")
    t = Tables(spark, larger)
    sensors = t.sensors.select("sensor_id", "kind", "x", "y").collect()
    up = {s.sensor_id: s.sensor_id for s in sensors}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sensors:
        for b in sensors:
            if a.kind < b.kind and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 225.0:
                up[root(a.sensor_id)] = root(b.sensor_id)
    cameras = [(s.x, s.y, root(s.sensor_id)) for s in sensors]
    assert len({c[2] for c in cameras}) < len(cameras)
    near = [(-len({g for x, y, g in cameras if (x - f.x) ** 2 + (y - f.y) ** 2 <= 40000.0}), f.name, f.facility_id) for f in t.facilities.select("facility_id", "name", "x", "y").collect()]
    want = [(i, -n, k) for k, (n, _, i) in enumerate(sorted(near), 1)]
    got = sorted(((r.facility_id, r.cameras, r["rank"]) for r in QUERIES["q_institutions"](spark, larger).collect()), key=lambda r: r[2])
    assert got == want and len(want) > 50


@pytest.mark.parametrize("name", ["agg_edge_traversals", "agg_sensing_power", "q_sensing_power", "agg_edge_class_coverage", "join_asof_keyframe", "agg_breakdown", "split_ways", "q_institutions", "q_tesla_field", "join_inner_hash", "join_left_default", "join_colinear", "drivability_mask"])
def test_sql_takes_all_rows(name):
    """The SQL too takes whole tables: no part of the ids, no limit."""
    assert not re.search(r"trip_id % \d+ = 0|l_orderkey % \d+ = 0|route_id % \d+|pu_min <|edge_id < \d+|LIMIT", SQL[name])


def test_trips_are_numbered_in_two_levels(spark):
    """The Spark side numbers trips without a window over the whole table."""
    t = Tables(spark, SF)
    rows = t.trips.select("trip_id", "pu_min", "dur_min", "trip_miles").collect()
    want = t.spark.sql(with_views("SELECT trip_id, pu_min, dur_min, trip_miles FROM v_trips").replace("FROM lineitem", "FROM {lineitem}").replace("JOIN orders", "JOIN {orders}").replace("JOIN customer", "JOIN {customer}").replace("JOIN supplier", "JOIN {supplier}"), **{n: t.table(n) for n in ("lineitem", "orders", "customer", "supplier")})
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want.collect()))
