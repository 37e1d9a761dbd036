"""Closed forms, small graphs and invariants."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.functions import geo, scalar
from kerbside.operators import geometry, graph, sequence, spatial
from kerbside.plans import composites
from kerbside.plans.views import Tables

SQUARE = "SELECT * FROM VALUES (0L, 0L, 1L, 10.0D), (1L, 1L, 2L, 10.0D), (2L, 2L, 3L, 10.0D), (3L, 3L, 0L, 10.0D) AS e(edge_id, from_id, to_id, length_m)"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_projection(spark):
    x, y, dy = one(spark, geo.enu_x(geo.ORIGIN_LON), geo.enu_y(geo.ORIGIN_LAT), geo.enu_y(geo.ORIGIN_LAT + 1))
    assert (x, y) == (0, 0) and abs(dy - 111195) < 500


@pytest.mark.parametrize(("x", "y", "covered"), [(0, 10, True), (5, 10, True), (0, 25, False), (0, -5, False), (15, 1, False), (0, 0, True)])
def test_wedge(spark, x, y, covered):
    assert one(spark, geo.covers(float(x), float(y), 0.0, 0.0, 0.0, math.pi / 4, 20.0))[0] is covered


def test_segments_that_touch_do_not_cross(spark):
    cross, touch = one(spark, geo.segments_cross(0.0, 0.0, 2.0, 2.0, 0.0, 2.0, 2.0, 0.0), geo.segments_cross(0.0, 0.0, 2.0, 0.0, 1.0, 0.0, 1.0, 5.0))
    assert cross and not touch


@pytest.mark.parametrize(("text", "minutes"), [("25:30:00", 1530.0), ("x", None), ("7:05", 425.0)])
def test_gtfs_minutes(spark, text, minutes):
    assert one(spark, scalar.gtfs_minutes(F.lit(text)))[0] == minutes


@pytest.mark.parametrize(("name", "base"), [("M14A-SBS", "M14"), ("Bx41", "BX41"), ("SIM", None)])
def test_route_base(spark, name, base):
    assert one(spark, scalar.route_base(F.lit(name)))[0] == base


@pytest.mark.parametrize(("name", "maker"), [("ELSAG", "Leonardo"), ("AutoVu", "Genetec"), ("Vigilant", "Motorola"), (None, "Other")])
def test_maker(spark, name, maker):
    assert one(spark, scalar.maker(F.lit(name).cast("string")))[0] == maker


def test_rush_midday_night(spark):
    rush, midday, night = one(spark, scalar.traffic(17.5), scalar.traffic(13.0), scalar.traffic(3.0))
    assert rush > midday > night


def test_square_graph(spark):
    edges = spark.sql(SQUARE)
    reached = graph.reach(edges, spark.sql("SELECT 0L AS source, 0L AS node_id"), 15.0)
    assert {r.node_id for r in reached.collect()} == {0, 1, 3}
    assert graph.isochrone_edges(edges, reached).count() == 2
    pairs = spark.sql("SELECT 1L AS pair_id, 0L AS start, 3L AS goal UNION ALL SELECT 2L, 0L, 9L")
    assert [(r.pair_id, r.total) for r in graph.shortest_paths(pairs, edges).collect()] == [(1, 10.0)]


@pytest.mark.parametrize("blocks", [1, 4])
def test_paths_and_walks_are_those_of_the_whole_graph(spark, blocks):
    """However a random graph with parallel edges is cut into blocks: costs by Bellman-Ford, paths that hold together, walks step by step."""
    rng = random.Random(blocks)
    edges = [(i, rng.randrange(60), rng.randrange(60), rng.randrange(1, 50) / 1.0, rng.choice([1.0, 8.0])) for i in range(110)]
    df = spark.createDataFrame(edges, "edge_id long, from_id long, to_id long, length_m double, penalty double")
    pairs = [(i, rng.randrange(62), rng.randrange(62)) for i in range(25)]
    cut = spark.createDataFrame([(n, n * 7919 % blocks) for n in range(62)], "node_id long, block long")
    rows = graph.shortest_paths(spark.createDataFrame(pairs, "pair_id long, start long, goal long"), df, penalty="penalty", blocks=cut, salts=2).collect()
    for pair, start, goal in pairs:
        best = {start: 0.0}
        for _ in range(62):
            for _, a, b, c, p in edges:
                for x, y in ((a, b), (b, a)):
                    if x in best and best[x] + c * p < best.get(y, math.inf):
                        best[y] = best[x] + c * p
        path = sorted((r.seq, r.edge_id, r.cost, r.total) for r in rows if r.pair_id == pair)
        assert bool(path) == (goal in best and start != goal)
        node, weighed = start, 0.0
        for k, (seq, edge, cost, total) in enumerate(path):
            _, a, b, c, p = edges[edge]
            assert seq == k and node in (a, b) and cost == c and total == sum(x[2] for x in path)
            node, weighed = a + b - node, weighed + c * p
        assert not path or node == goal and weighed == pytest.approx(best[goal])
    starts = [(w, rng.randrange(62)) for w in range(20)]
    got = sorted((r.walk_id, r.step, r.node_id) for r in graph.random_walks(spark.createDataFrame(starts, "walk_id long, node_id long"), df, 6, 3, cut, 2).collect())
    want = []
    for walk, node in starts:
        want.append((walk, 0, node))
        last = None
        for k in range(1, 7):
            found = sorted((e, y) for e, a, b, _, _ in edges for x, y in ((a, b), (b, a)) if x == node)
            if not found:
                break
            ahead = [x for x in found if x[0] != last] or found
            last, node = ahead[graph.draw(3, walk, k, len(ahead))]
            want.append((walk, k, node))
    assert got == sorted(want)


def test_pace_and_dwell(spark):
    points = spark.sql("SELECT * FROM VALUES (1L, 0L, 0.0D, 0.0D), (1L, 1L, 200.0D, 0.0D) AS p(r, seq, x, y)")
    assert [r.time_frac for r in sequence.paced(points, "r").orderBy("seq").collect()] == [0.0, 1.0]
    late, mid = one(spark, sequence.dwelled(0.0, 100.0, 0.0, 1.0, 0.9), sequence.dwelled(0.0, 100.0, 0.0, 1.0, 0.375))
    assert late == 100 and 0 < mid < 100


def test_ticks_sum_to_the_duration_and_one(spark):
    d = spark.sql("SELECT 1L AS k, 9.5D AS dur")
    total = lambda **a: sequence.ticks(d, "dur", **a).agg(F.sum("weight")).first()[0]
    assert math.isclose(total(), 10.5) and math.isclose(total(exact=True), 9.5)


def test_clip_and_hull():
    box = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    part = geometry.clip_convex(box + 1, box)
    assert part.max() == 2 and part.min() == 1
    assert not len(geometry.clip_convex(box + 9, box))
    assert geometry.hull(np.array([(0, 0), (1, 1)], float)) is None


def test_grid_join_equals_cross_join(spark):
    rng = np.random.default_rng(5)
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-300, 300, (200, 2)))], "id long, x double, y double")
    b = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-300, 300, (150, 2)))], "site long, sx double, sy double")
    got = {(r.id, r.site) for r in spatial.within(a, b, 35.0).collect()}
    assert got == {(r.id, r.site) for r in a.crossJoin(b).where((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2 <= 35.0**2).collect()}
    plan = spatial.within(a, b, 35.0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_nested_loop_in_the_flagship(spark):
    from kerbside.plans import catalog

    plan = catalog.queries()["q_edge_heatmap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    joins = [line for line in plan.splitlines() if "NestedLoopJoin" in line or "CartesianProduct" in line]
    assert all(", Cross" in line for line in joins)  # the views' own lists of corners


def test_kiosks_and_facilities(spark):
    from kerbside.sources import readers

    k = spark.sql("SELECT * FROM VALUES ('40.7', '-74', 'Live'), ('40.8', '-73.9', 'Repair'), (NULL, '-74', 'Live') AS k(latitude, longitude, status)")
    assert [r.wifi_live for r in readers.online_kiosks(k).orderBy("lat").collect()] == [True, False]


def test_services_and_forward_stops(spark):
    from kerbside.operators import timetable

    week = ", ".join(f"'{int(d == 2)}' AS {n}" for d, n in enumerate(timetable.WEEKDAYS))  # Wednesdays
    calendar = spark.sql(f"SELECT s AS service_id, {week}, a AS start_date, b AS end_date FROM VALUES ('in', '20240101', ' 20240117'), ('out', '20240101', '20240116'), ('gone', '20240101', '20241231') AS v(s, a, b)")
    dates = spark.sql("SELECT * FROM VALUES ('gone', '20240117', '2'), ('new', ' 20240117', '1'), ('late', '20240118', '1'), ('in', '20240118', '2') AS v(service_id, date, exception_type)")
    assert {r.service_id for r in timetable.active_services(calendar, dates, "20240117").collect()} == {"in", "new"}
    assert {r.service_id for r in timetable.active_services(calendar, dates, "20240118").collect()} == {"late"}
    # a shape that runs 100 m east and comes back 1 m north: the second stop is nearest to the way out, the third to its middle
    points = spark.sql("SELECT * FROM VALUES ('h', 0L, 0D, 0D), ('h', 1L, 100D, 0D), ('h', 2L, 100D, 1D), ('h', 3L, 0D, 1D) AS v(shape_id, seq, x, y)")
    stops = spark.sql("SELECT * FROM VALUES ('h', 'a', 90D, 0.9D), ('h', 'b', 10D, 0.2D), ('h', 'c', 50D, 0.5D) AS v(shape_id, stop_id, px, py)")
    got = {r.stop_id: r.arc for r in timetable.stop_arcs(stops, points).collect()}
    assert got == {"a": 111.0, "b": 10.0, "c": 50.0}  # c lies between both ways: the first one


def test_ties_between_stretches_outlast_degrees(spark):
    """Stops as far from two stretches of a route lie on the first, though a feed gives all places in degrees."""
    from kerbside.operators import timetable
    from kerbside.plans.views import VIEWS

    ties = [(780, 5100, 0.0), (1986, 3800, 0.0), (1380, 11100, 0.0), (786, 11800, 0.0), (80, 18100, 0.0), (636, 10300, 0.0), (1436, 18300, 0.0), (1770, 5426, 41.231056), (1430, 11600, 0.0), (1270, 8050, 0.0)]
    found = spark.createDataFrame(ties, "s_suppkey long, p_partkey long, arc double")
    text = lambda c: c.cast("string")
    points = spark.sql(VIEWS["v_route_points"].replace("FROM supplier", "FROM {s}"), s=found)
    shapes = points.select(F.col("route_id").alias("shape_id"), text(geo.enu_lat("y")).alias("shape_pt_lat"), text(geo.enu_lon("x")).alias("shape_pt_lon"), text(F.col("seq")).alias("shape_pt_sequence"))
    at = spark.sql(composites.FEED_STOPS.replace("FROM part", "FROM {p}"), p=found).select("stop_id", text(geo.enu_lat("py")).alias("lat"), text(geo.enu_lon("px")).alias("lon"))
    stops = timetable.placed(at, "lat", "lon").select("stop_id", F.col("x").alias("px"), F.col("y").alias("py"))
    pairs = found.select(F.col("s_suppkey").alias("shape_id"), F.col("p_partkey").alias("stop_id"))
    arcs = timetable.stop_arcs(pairs.join(stops, "stop_id"), timetable.shape_points(shapes)).collect()
    assert sorted((r.shape_id, r.stop_id, round(r.arc, 6) + 0.0) for r in arcs) == sorted(ties)


def test_reach_by_blocks(spark):
    """Costs as by a plain search on a random graph, cut into blocks in several ways, from several sources."""
    import heapq
    import random

    rng = random.Random(6)
    links = [(i, rng.randrange(120), rng.randrange(120), rng.choice([1.0, 2.5, 7.0])) for i in range(260)]
    edges = spark.createDataFrame(links, "edge_id long, from_id long, to_id long, length_m double")
    sources = spark.createDataFrame([(0, 3), (1, 50), (2, 3), (3, 119)], "source long, node_id long")
    around = {}
    for _, a, b, c in links:
        around.setdefault(a, []).append((b, c))
        around.setdefault(b, []).append((a, c))
    want = set()
    for s, start in ((0, 3), (1, 50), (2, 3), (3, 119)):
        best, heap = {}, [(0.0, start)]
        while heap:
            c, n = heapq.heappop(heap)
            if n not in best:
                best[n] = c
                for m, d in around.get(n, ()):
                    if c + d <= 12.0:
                        heapq.heappush(heap, (c + d, m))
        want |= {(s, n, c) for n, c in best.items()}
    for size, salts in ((7, 2), (1000, 1)):
        blocks = spark.range(120).select(F.col("id").alias("node_id"), F.floor(F.col("id") / size).alias("block"))
        assert {tuple(r) for r in graph.reach(edges, sources, 12.0, blocks=blocks, salts=salts).collect()} == want


def test_rounds_of_reach_follow_blocks(spark):
    """A street of the same length with ten times the nodes takes as many rounds."""
    rounds = []
    for n in (80, 800):
        step = 800.0 / n
        edges = spark.range(n).select(F.col("id").alias("edge_id"), F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"), F.lit(step).alias("length_m"))
        cells = spark.range(n + 1).select(F.col("id").alias("node_id"), F.floor(F.col("id") * step / 200).alias("block"))
        seen: list[int] = []
        far = graph.reach(edges, spark.sql("SELECT 0L AS source, 0L AS node_id"), 800.0, blocks=cells, seen=seen)
        assert far.count() == n + 1 and far.agg(F.max("cost")).first()[0] == 800.0
        rounds.append(len(seen))
    assert rounds[0] == rounds[1] <= 7


def test_who_is_under_way(spark):
    import random

    from kerbside.operators import fleet

    rng = random.Random(2)
    rows = [(i, float(rng.randrange(0, 300)), rng.choice([0.0, 0.5, 3.0, 40.0])) for i in range(400)]
    trips = spark.createDataFrame(rows, "trip_id long, start double, dur double")
    instants = spark.createDataFrame([(0.0,), (12.0,), (12.5,), (290.0,), (10_000.0,)], "now double")
    want = {(i, n) for i, s, d in rows for n in (0.0, 12.0, 12.5, 290.0) if s <= n < s + d}
    for longest in (None, 40.0):
        assert {(r.trip_id, r.now) for r in fleet.active_at(trips, instants, "start", "dur", longest).collect()} == want
    assert fleet.active_at(trips.limit(0), instants, "start", "dur").count() == 0


def test_streets_are_entered_once_a_visit(spark):
    from kerbside.operators import fleet

    edges = spark.sql("SELECT * FROM VALUES (1L, 0D, 0D, 100D, 0D), (2L, 100D, 0D, 200D, 0D), (3L, 0D, 60D, 200D, 60D) AS e(edge_id, x0, y0, x1, y1)")
    # along edge 1, off the streets for a while, back on edge 1, then on to edge 2 and back
    path = [(10, 1), (60, 1), (60, -80), (90, -80), (90, 1), (180, 1), (20, 1)]
    points = spark.createDataFrame([(7, i, float(x), float(y)) for i, (x, y) in enumerate(path)], "route long, seq long, x double, y double")
    assert {(r.edge_id, r.entries) for r in fleet.street_entries(points, edges, "route").collect()} == {(1, 2), (2, 1)}


def test_grid_heatmap_by_class(spark):
    """Each class's cells lie in 0..1 with the hottest at 1, and the classes differ."""
    t = Tables(spark, "/root/testdata/sf0.001")
    heat = {c: {r.cell_id: r.heat for r in composites.grid_heat(t, c).collect()} for c in ("fixed", "ace", "total")}
    for cells in heat.values():
        assert len(cells) == 48 * 48 and min(cells.values()) >= 0 and max(cells.values()) == 1
    assert heat["fixed"] != heat["ace"] != heat["total"]
