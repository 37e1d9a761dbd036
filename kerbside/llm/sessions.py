"""Late session merging: every version of every session, as batches of events arrive, some of them late.

Three steps. An aggregate gathers events by user, batch and bin of time as wide as the gap; events of one bin are always
within the gap of each other, so a bin is a piece of one session, and map-side combine shrinks a hot user before anything
moves. Windows chain the bins of a user's batch to mini-sessions. Then one sweep over partitions sorted by user, batch and
start merges each batch's sorted mini-sessions with the user's standing sorted sessions: a linear merge of two sorted runs,
over the part of the standing run that the batch reaches. What a merged session absorbs is retracted, and leaves with the
version that retracts it.

Scale: two exchanges, by user, batch and bin, then by user; both carry bins, of which a user has at most batches times
(span of time / gap), whatever the number of events. The sweep streams: it holds one user's standing sessions and nothing
of other users. No count, list or table goes to the driver.

Defined cases: events whose user, batch or time is null take no part; a null weight counts as 0; repeated rows are events of
their own; equal times share a session; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

GAP, BATCH_SECONDS = 600, 900

_COLUMNS = ("user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s")
_ARROW = pa.schema([(c, pa.int64()) for c in _COLUMNS])
_DDL = ", ".join(f"{c} long" for c in _COLUMNS)


def _floor(x: Column, n: int) -> Column:
    """floor(x / n) in integers."""
    return ((x - F.pmod(x, F.lit(n))) / n).cast("long")


def mini_sessions(events: DataFrame, gap: int = GAP) -> DataFrame:
    """events(user, batch, time, weight) -> the sessions of each user's batch by itself, dealt and sorted by user, batch, start."""
    bins = (
        events.where("user IS NOT NULL AND batch IS NOT NULL AND time IS NOT NULL")
        .groupBy("user", "batch", _floor(F.col("time"), gap).alias("bin"))
        .agg(F.min("time").alias("start_s"), F.max("time").alias("end_s"), F.count("*").alias("n"), F.sum(F.coalesce("weight", F.lit(0))).cast("long").alias("h"))
        .repartition("user")
    )
    own = Window.partitionBy("user", "batch").orderBy("bin")
    apart = F.coalesce(F.col("start_s") - F.lag("end_s").over(own) > gap, F.lit(True)).cast("int")
    chained = bins.withColumn("apart", apart).withColumn("part", F.sum("apart").over(own))
    minis = chained.groupBy("user", "batch", "part").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum("n").alias("n"), F.sum("h").alias("h"))
    return minis.select("user", "batch", "start_s", "end_s", "n", "h").sortWithinPartitions("user", "batch", "start_s")


class Standing:
    """One user's standing sessions, sorted; apart by more than the gap."""

    def __init__(self, user: int, gap: int) -> None:
        self.user, self.gap = user, gap
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.rows: list[tuple] = []  # batch, start, end, events, new events, retracted, weight

    def merge(self, batch: int, minis: list[tuple[int, int, int, int]]) -> list[tuple]:
        """Merges a batch's sorted mini-sessions (start, end, events, weight) in; the versions that this retracts."""
        gap = self.gap
        low, high = bisect_left(self.ends, minis[0][0] - gap), bisect_right(self.starts, max(e for _, e, _, _ in minis) + gap)
        run, out, gone = self.rows[low:high], [], []
        i = k = 0
        while i < len(run) or k < len(minis):
            start = min(run[i][1] if i < len(run) else minis[k][0], minis[k][0] if k < len(minis) else run[i][1])
            end, events, new, weight, taken = start, 0, 0, 0, []
            while True:
                if i < len(run) and run[i][1] - end <= gap:
                    taken.append(run[i])
                    end, events, weight = max(end, run[i][2]), events + run[i][3], weight + run[i][6]
                    i += 1
                elif k < len(minis) and minis[k][0] - end <= gap:
                    end, events, new, weight = max(end, minis[k][1]), events + minis[k][2], new + minis[k][2], weight + minis[k][3]
                    k += 1
                else:
                    break
            if new:
                gone += [self.row(t, batch, start) for t in taken]
                out.append((batch, start, end, events, new, len(taken), weight))
            else:
                out += taken
        self.rows[low:high] = out
        self.starts[low:high] = [r[1] for r in out]
        self.ends[low:high] = [r[2] for r in out]
        return gone

    def row(self, t: tuple, batch: int | None = None, start: int | None = None) -> tuple:
        return (self.user, *t, batch, start)


def _sweep(gap: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            standing, batch, minis = None, None, []
            for part in parts:
                for user, b, *mini in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if standing is None or user != standing.user or b != batch:
                        if minis:
                            yield from standing.merge(batch, minis)
                        if standing is None or user != standing.user:
                            if standing is not None:
                                yield from map(standing.row, standing.rows)
                            standing = Standing(user, gap)
                        batch, minis = b, []
                    minis.append(tuple(mini))
            if standing is not None:
                yield from standing.merge(batch, minis)
                yield from map(standing.row, standing.rows)

        yield from common.batches(_ARROW, rows())

    return run


def versions(events: DataFrame, gap: int = GAP) -> DataFrame:
    """events(user, batch, time, weight: long) -> every version of every session."""
    return mini_sessions(events, gap).mapInArrow(_sweep(gap), _DDL)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Turns as events: user, second, batch (of arrival; a fifth of them up to three batches late) and weight by hash."""
    crc = lambda x: F.crc32(x.cast("string").cast("binary"))
    known = conversations.where("turn IS NOT NULL AND conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"))
    hashed = known.select("conv_id", "turn", crc(F.col("conv_id")).alias("c"), crc(F.concat_ws(":", "conv_id", "turn")).alias("h"))
    late = _floor(F.col("h"), 600)
    timed = hashed.select(
        (2 * _floor(F.col("conv_id"), 8) + F.col("c") % 2).alias("user"),
        (_floor(F.col("c"), 2) % 7200 + 300 * F.col("turn") + F.col("h") % 600).alias("time"),
        F.when(late % 5 == 0, late % 4).otherwise(0).alias("late"),
        F.col("h").alias("weight"),
    )
    return timed.select("user", (_floor(F.col("time"), BATCH_SECONDS) + F.col("late")).alias("batch"), "time", "weight")


def op12_late_sessions(spark, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return versions(conversation_events(common.table(spark, sf_dir, "conversations").select("conv_id", "turn")))


SQL = """
WITH RECURSIVE steps(i, c, k) AS (
    SELECT i, i, 0 FROM range(256) t(i)
    UNION ALL
    SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS l FROM steps WHERE k = 8),
turns AS (
    SELECT row_number() OVER () AS id, conv_id, turn, l,
        list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS conv_bytes,
        list_transform(string_split(conv_id || ':' || turn, ''), lambda x: CAST(ascii(x) AS BIGINT)) AS turn_bytes
    FROM conversations, crc WHERE turn IS NOT NULL AND conv_id IS NOT NULL
),
hashed AS (
    SELECT id, conv_id, turn,
        xor(list_reduce(conv_bytes, lambda a, b: xor(a // 256, l[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS c,
        xor(list_reduce(turn_bytes, lambda a, b: xor(a // 256, l[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h
    FROM turns
),
timed AS (
    SELECT id, h, 2 * CAST(floor(conv_id / 8.0) AS BIGINT) + c % 2 AS usr, (c // 2) % 7200 + 300 * turn + h % 600 AS s,
        CASE WHEN (h // 600) % 5 = 0 THEN (h // 600) % 4 ELSE 0 END AS late
    FROM hashed
),
events AS (SELECT id, h, usr, s, CAST(floor(s / 900.0) AS BIGINT) + late AS batch FROM timed),
arrivals AS (SELECT DISTINCT usr, batch FROM events),
so_far AS (
    SELECT a.usr, a.batch, e.id, e.s, e.h, e.batch AS own,
        CASE WHEN e.s - lag(e.s) OVER (PARTITION BY a.usr, a.batch ORDER BY e.s, e.id) <= 600 THEN 0 ELSE 1 END AS apart
    FROM arrivals a JOIN events e ON e.usr = a.usr AND e.batch <= a.batch
),
parts AS (SELECT *, sum(apart) OVER (PARTITION BY usr, batch ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS part FROM so_far),
versions AS (
    SELECT usr, batch, min(s) AS start_s, max(s) AS end_s, count(*) AS n_events, count(*) FILTER (WHERE own = batch) AS n_new, sum(h) AS h_sum
    FROM parts GROUP BY usr, batch, part HAVING count(*) FILTER (WHERE own = batch) > 0
),
ended AS (
    SELECT p.usr, p.batch, p.start_s, min(q.batch) AS by_batch, arg_min(q.start_s, q.batch) AS by_start
    FROM versions p JOIN versions q ON q.usr = p.usr AND q.batch > p.batch AND q.start_s <= p.start_s AND p.end_s <= q.end_s
    GROUP BY p.usr, p.batch, p.start_s
),
absorbed AS (SELECT usr, by_batch, by_start, count(*) AS n FROM ended GROUP BY usr, by_batch, by_start)
SELECT CAST(v.usr AS BIGINT) AS "user", CAST(v.batch AS BIGINT) AS batch, CAST(v.start_s AS BIGINT) AS start_s, CAST(v.end_s AS BIGINT) AS end_s,
    CAST(v.n_events AS BIGINT) AS n_events, CAST(v.n_new AS BIGINT) AS n_new, CAST(coalesce(a.n, 0) AS BIGINT) AS n_retracted, CAST(v.h_sum AS BIGINT) AS h_sum,
    CAST(e.by_batch AS BIGINT) AS retracted_batch, CAST(e.by_start AS BIGINT) AS retracted_start_s
FROM versions v
LEFT JOIN ended e ON e.usr = v.usr AND e.batch = v.batch AND e.start_s = v.start_s
LEFT JOIN absorbed a ON a.usr = v.usr AND a.by_batch = v.batch AND a.by_start = v.start_s
"""
