"""Streams of hand-made arrivals: what is late, what stays open, and what restarts keep."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from kerbside.streaming import streams

DAY = dt.datetime(2024, 3, 1, tzinfo=dt.UTC)


def arrivals(spark, rows):
    """rows(period, key, event_id, minute)."""
    data = [(p, k, e, DAY + dt.timedelta(minutes=m)) for p, k, e, m in rows]
    return spark.createDataFrame(data, "period int, key string, event_id long, ts timestamp")


def minutes(column):
    return (F.unix_timestamp(column) - int(DAY.timestamp())) / 60


def test_windows_close_behind_the_watermark(spark, tmp_path):
    # period 1 sets the watermark to 100 - 10: minutes up to 90 are closed, row 4 is late, row 5 is not
    table = arrivals(spark, [(1, "a", 1, 10.5), (1, "a", 2, 100), (2, "a", 4, 10.6), (2, "a", 5, 90.5), (2, "b", 6, 200), (3, "a", 7, 100.2), (3, "a", 8, 191), (3, "a", 9, 211)])
    out = streams.arriving(table, "period", lambda rows: streams.tumbling(rows, "1 minute", "key"), f"file://{tmp_path}/w")
    got = {(r.key, r.m, r.n) for r in out.select("key", minutes("start").alias("m"), "n").collect()}
    assert got == {("a", 10, 1), ("a", 90, 1), ("a", 100, 1), ("a", 191, 1), ("b", 200, 1)}  # 100.2 is late, 211 still open


def test_timers_emit_the_last_event_of_a_burst(spark, tmp_path):
    rows = [
        (1, "a", 1, 0), (1, "a", 2, 5), (1, "a", 3, 40), (1, "b", 4, 1), (1, "b", 5, 100),
        (2, "a", 6, 95), (2, "b", 7, 60), (2, "c", 8, 110), (2, "c", 8, 110), (2, "b", 9, 101),
        (3, "c", 10, 125), (3, "d", 11, 400),
    ]
    out = streams.arriving(arrivals(spark, rows), "period", lambda r: streams.settled_events(r, 1800, "key"), f"file://{tmp_path}/d")
    got = sorted((r.key, r.event_id) for r in out.collect())
    # 1 gives way to 2; 7 comes when the watermark is 90; 5 to 9; 8 to 10 across a restart; 11 waits for its timer
    assert got == [("a", 2), ("a", 3), ("a", 6), ("b", 4), ("b", 9), ("c", 10)]


def test_repeats_are_dropped_across_restarts(spark, tmp_path):
    rows = [(1, "a", 1, 0), (1, "a", 1, 0), (1, "a", 2, 50), (2, "a", 2, 50), (2, "a", 3, 45), (2, "a", 4, 30), (3, "a", 3, 45)]
    out = streams.arriving(arrivals(spark, rows), "period", lambda r: streams.once(r.select("event_id", "ts"), "event_id"), f"file://{tmp_path}/o")
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3]


def test_sessions_meet_across_restarts(spark, tmp_path):
    rows = [(1, "a", 1, 0), (1, "a", 2, 60), (2, "a", 3, 80), (2, "a", 4, 45), (2, "b", 5, 200), (3, "b", 6, 300)]
    out = streams.arriving(arrivals(spark, rows), "period", lambda r: streams.sessions(r, "30 minutes", "key"), f"file://{tmp_path}/s")
    got = {(r.key, r.a, r.b, r.n) for r in out.select("key", minutes("start").alias("a"), minutes("end").alias("b"), "n").collect()}
    assert got == {("a", 0, 30, 1), ("a", 45, 110, 3), ("b", 200, 230, 1)}
    assert streams.arriving(arrivals(spark, rows).limit(0), "period", lambda r: r, f"file://{tmp_path}/n").count() == 0
