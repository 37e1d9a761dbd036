"""What larger tables must not multiply: sides of joins, places that many rows share, rounds, what a task holds."""

from __future__ import annotations

import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from kerbside.operators import spatial
from kerbside.plans import catalog, composites
from kerbside.plans.views import TABLES, Tables

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
#: Keys that are shifted from copy to copy, by multiples of 1,260,000: places, headings and remainders repeat.
KEYS = {"customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "events": ("event_id",)}


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """The tables with three copies of customers, suppliers, parts and events that lie on one another."""
    out = tmp_path_factory.mktemp("copies")
    con = duckdb.connect()
    for t in TABLES:
        if t in KEYS:
            shifted = ", ".join(f"{k} + i * 1260000 AS {k}" for k in KEYS[t])
            con.execute(f"COPY (SELECT * REPLACE ({shifted}) FROM '{SF}/{t}.parquet', RANGE(3) r(i)) TO '{out}/{t}.parquet' (FORMAT parquet)")
        else:
            shutil.copy(f"{SF}/{t}.parquet", out)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{out}/{t}.parquet')")
    return str(out), con


def same_as_sql(spark, copies, name):
    folder, con = copies
    df = QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]}) q").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def joins(df) -> set[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {j for j in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin") if j in plan}


def test_dealt_points_are_merged(spark):
    """Spark takes the dealt side to be as small as before it was dealt, and would broadcast it."""
    points = spark.range(50).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    sites = points.select(F.col("id").alias("site"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    for how in ("inner", "left_semi", "left_anti"):
        assert joins(spatial.within(points, sites, 3.0, how=how)) == {"SortMergeJoin"}


def test_live_walk_meets_each_place_once(spark, copies):
    """Three facilities at each place: no more rows are met, and all have their captures, also where a range goes round."""
    one, three = Tables(spark, SF), Tables(spark, copies[0])
    met = composites.live_passes(three.pings, composites.sites(one)).count()
    assert composites.live_passes(three.pings, composites.sites(three)).count() == met > 0
    same_as_sql(spark, copies, "q_live_walk")


def test_live_ranges_hold_the_draws(spark):
    """Events all over the circle near facilities that share a place: counts as by the draw of each pair."""
    types = [e for e, _, _ in composites.LIVE_CLASSES.values()] + ["other"]
    pings = [(i * i * 5_003 + i, types[i % 6], float(i % 31) - 15, 0.0) for i in range(1200)] + [(None, "view", 0.0, 0.0), (1, None, 0.0, 0.0)]
    walkers = [(i * i * 104_729, float(i % 3) * 9, 0.0) for i in range(40)] + [(7, 500.0, 0.0), (0, 0.0, 0.0)]
    p, w = spark.createDataFrame(pings, "event_id long, event_type string, x double, y double"), spark.createDataFrame(walkers, "facility_id long, sx double, sy double")
    pairs = p.crossJoin(w).withColumn("draw", F.expr(composites.DRAW)).withColumn("d2", F.expr("(x - sx) * (x - sx) + (y - sy) * (y - sy)")).where(composites.LIVE_PASS)
    want = pairs.groupBy("facility_id").agg(*(F.expr(c).alias(n) for n, c in composites.LIVE_COUNTS.items()))
    got = composites.live_captures(p, w)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_corridor_has_each_place_once(spark, copies):
    once, thrice = (composites.corridor(Tables(spark, d)) for d in (SF, copies[0]))
    assert thrice.count() == once.distinct().count() == once.count()


def test_heatmap_of_copies(spark, copies):
    same_as_sql(spark, copies, "q_edge_heatmap")
    same_as_sql(spark, copies, "q_grid_heatmap")


@pytest.mark.parametrize("name", ["q_mobile_integral", "q_route_exposure", "agg_institution_type_avg", "q_institutions", "graph_components", "join_nearest_pick", "join_within_distance", "clip_polygon", "agg_first_seen", "join_capture"])
def test_copies_in_one_place(spark, copies, name):
    same_as_sql(spark, copies, name)


def test_copied_routes_are_one_walk(spark, copies):
    walk = composites.walks(Tables(spark, copies[0]))
    assert walk.count() == 3 * walk.select("walk").distinct().count()


def test_places_are_paired_once(spark, copies, monkeypatch):
    """What the spatial joins give before rows are put in must not grow with the copies."""
    pairs = {}
    within = spatial.within

    def counted(*a, **k):
        out = within(*a, **k)
        if k.get("how", "inner") == "inner":
            pairs.setdefault(folder, []).append(out.count())
        return out

    monkeypatch.setattr(spatial, "within", counted)
    for name in ("agg_institution_type_avg", "q_institutions", "join_within_distance", "graph_components"):
        for folder in (SF, copies[0]):
            QUERIES[name](spark, folder).count()
    assert pairs[SF] == pairs[copies[0]]


def test_edge_ticks_are_broadcast(spark):
    """Sensors, however many, stay where they are read."""
    assert "SortMergeJoin" not in joins(QUERIES["join_capture"](spark, SF))


def test_rank_passes_read_values_once(spark):
    """What computes the rows must not run again for each pass."""
    from kerbside.operators import order

    runs = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        runs.add(1)
        return float(i * 7919 % 5003)

    got, n, *_ = order.at_ranks(spark.range(20000).select(value("id").alias("x")), "x", lambda n: [0, n // 2])
    assert got == [0.0, sorted(i * 7919 % 5003 for i in range(20000))[10000]] and n == 20000
    assert runs.value <= 2 * n  # filter and projection may each ask for it


def test_trips_without_numbers_are_the_trips(spark):
    t = Tables(spark, SF)
    assert "Window" not in t.trip_rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, t.trip_rows.collect())) == sorted(map(tuple, t.trips.drop("trip_id").collect()))


def test_search_stays_near_its_goal(spark):
    """A goal two streets away must not settle the whole block."""
    from kerbside.operators import graph

    edges = spark.range(900).select(F.col("id").alias("edge_id"), F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"), F.lit(1.0).alias("c"))
    sources, goals = (spark.createDataFrame([(0, n)], "source long, node_id long") for n in (400, 402))
    assert graph._expanded(edges, sources, float("inf"), "c", None, 1, 100, goals=goals).count() < 50
