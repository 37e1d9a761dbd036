"""Session versions against a replay of each user's events, and on odd tables."""

from __future__ import annotations

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kerbside.llm import common, sessions

EVENTS = "user long, batch long, time long, weight long"


def replay(events, gap):
    """Every version, from all events so far after each batch."""
    out = []
    by_user = collections.defaultdict(list)
    for user, batch, time, weight in events:
        if user is not None and batch is not None and time is not None:
            by_user[user].append((batch, time, weight or 0))
    for user, own in by_user.items():
        standing: list[dict] = []
        for batch in sorted({b for b, _, _ in own}):
            so_far = sorted((t, b, w) for b, t, w in own if b <= batch)
            groups = [[so_far[0]]]
            for x in so_far[1:]:
                if x[0] - groups[-1][-1][0] <= gap:
                    groups[-1].append(x)
                else:
                    groups.append([x])
            for g in groups:
                new = sum(b == batch for _, b, _ in g)
                if not new:
                    continue
                inside = [s for s in standing if g[0][0] <= s["start"] and s["end"] <= g[-1][0]]
                for s in inside:
                    s["by"] = (batch, g[0][0])
                    standing.remove(s)
                version = {"start": g[0][0], "end": g[-1][0], "by": (None, None), "row": (user, batch, g[0][0], g[-1][0], len(g), new, len(inside), sum(w for _, _, w in g))}
                standing.append(version)
                out.append(version)
    return sorted(((*v["row"], *v["by"]) for v in out), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_versions(spark, seed):
    rng = random.Random(seed)
    gap = (600, 1, 7, 60)[seed]
    span = (9000, 40, 300, 100_000)[seed]
    events = [(rng.randrange(6) if rng.random() < 0.6 else 0, rng.randrange(-1, 9), rng.randrange(-span, span), rng.randrange(1 << 32)) for _ in range(500)]
    events += events[:40] + [(1, 2, None, 3), (None, 2, 3, 4), (1, None, 5, 6), (1, 3, 9, None)]
    common.prepare(spark)
    df = spark.createDataFrame(events, EVENTS).repartition(5).withColumn("start_s", F.lit("x")).withColumn("n", F.lit(1))
    assert sorted(map(tuple, sessions.versions(df, gap).collect()), key=repr) == replay(events, gap)


def test_conversations(spark):
    turns = [(i, t) for i in (*range(-20, 90), 10**15 + 3) for t in range(i % 7)] + [(3, 1), (3, 1), (3, -4), (None, 1), (4, None), (None, None)]
    events = []
    for i, t in turns:
        if i is None or t is None:
            continue
        c, h = zlib.crc32(str(i).encode()), zlib.crc32(f"{i}:{t}".encode())
        g, s = h // 600, c // 2 % 7200 + 300 * t + h % 600
        events.append((2 * (i // 8) + c % 2, s // 900 + (g % 4 if g % 5 == 0 else 0), s, h))
    df = spark.createDataFrame(turns, "conv_id long, turn long").withColumn("user", F.lit("x"))
    got = sessions.conversation_events(df)
    assert sorted(map(tuple, got.collect())) == sorted(events)
    common.prepare(spark)
    assert sorted(map(tuple, sessions.versions(got).collect()), key=repr) == replay(events, 600)
    assert sessions.versions(got.limit(0)).count() == 0


def test_a_hot_user_is_gathered_before_it_moves(spark):
    """300,000 events of one user: what is exchanged by user are bins."""
    events = spark.range(300_000).select(F.lit(1).cast("long").alias("user"), (F.col("id") % 11).alias("batch"), (F.col("id") * 7 % 9900).alias("time"), F.lit(1).cast("long").alias("weight"))
    common.prepare(spark)
    minis = sessions.mini_sessions(events)
    assert minis.count() <= 11 * 17
    assert minis.agg(F.sum("n")).first()[0] == 300_000
    rows = sessions.versions(events).collect()
    assert max(r.n_events for r in rows) == 300_000 and sum(r.retracted_batch is None for r in rows) == 1
