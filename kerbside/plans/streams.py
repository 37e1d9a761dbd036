"""Streaming queries. The clicks arrive month by month, many of them late, and each query drains a stream of what has landed,
started anew on one checkpoint each month; the SQL says which rows are late. Throttling and the wrapped clock are batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators import sequence
from kerbside.streaming import streams

from .registry import query
from .sources import place
from .views import Tables

#: Clicks with the month of their arrival, and the watermark (microseconds) that the months before have set; 13: after all.
ARRIVED = """WITH c AS (SELECT *, EPOCH_US(ts) AS us, CAST(EXTRACT(MONTH FROM arrived_at) AS BIGINT) AS month FROM clicks WHERE ts IS NOT NULL AND arrived_at IS NOT NULL),
  m AS (SELECT DISTINCT month FROM c UNION SELECT 13),
  w AS (SELECT m.month, COALESCE(MAX(c.us) // 1000 * 1000 - 600000000, 0) AS wm FROM m LEFT JOIN c ON c.month < m.month GROUP BY m.month),
  r AS (SELECT c.*, w.wm, (SELECT wm FROM w WHERE month = 13) AS last FROM c JOIN w ON w.month = c.month)"""


def arriving(t: Tables, build) -> DataFrame:
    clicks = t.table("clicks").where("ts IS NOT NULL AND arrived_at IS NOT NULL").select("click_id", "ts", "client_id", "kind", "value", F.month("arrived_at").alias("month"))
    return streams.arriving(clicks, "month", build, place(t, "stream"))


def seconds(column: str):
    return F.unix_timestamp(F.col(column).cast("timestamp")).alias("start")


@query("stream_tumbling_minute", f"""{ARRIVED} SELECT kind, start * 60 AS start, COUNT(*) AS n FROM (SELECT *, us // 60000000 AS start FROM r) q
  WHERE (start + 1) * 60000000 > wm AND (start + 1) * 60000000 <= last GROUP BY kind, start""")
def stream_tumbling_minute(t: Tables) -> DataFrame:
    return arriving(t, lambda rows: streams.tumbling(rows, "1 minute", "kind")).select("kind", seconds("start"), "n")


@query("stream_sliding_active", f"""{ARRIVED} SELECT start * 60 AS start, COUNT(*) AS n FROM (SELECT *, us // 60000000 - k AS start FROM r JOIN (SELECT UNNEST(RANGE(0, 30)) AS k) k ON TRUE) q
  WHERE (start + 30) * 60000000 > wm AND (start + 30) * 60000000 <= last GROUP BY start""")
def stream_sliding_active(t: Tables) -> DataFrame:
    return arriving(t, lambda rows: streams.sliding(rows, "30 minutes", "1 minute")).select(seconds("start"), "n")


def _sessions_sql(gap_us: int) -> str:
    """Month by month: what is open joins the month's rows; then what the new watermark has passed is closed."""
    steps, closed = ["o1 AS (SELECT client_id, us AS a, us AS b, 1 AS n FROM r WHERE FALSE)"], []
    for month in range(1, 6):
        steps.append(f"""a{month} AS (SELECT * FROM o{month} UNION ALL SELECT client_id, us, us + {gap_us}, 1 FROM r WHERE month = {month} AND us + {gap_us} > wm AND client_id IS NOT NULL),
  f{month} AS (SELECT *, CASE WHEN a <= MAX(b) OVER (PARTITION BY client_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM a{month}),
  s{month} AS (SELECT client_id, MIN(a) AS a, MAX(b) AS b, SUM(n) AS n FROM (SELECT *, SUM(f) OVER (PARTITION BY client_id ORDER BY a, b RANGE UNBOUNDED PRECEDING) AS k FROM f{month}) q GROUP BY client_id, k),
  w{month} AS (SELECT COALESCE(MAX(us) // 1000 * 1000 - 600000000, 0) AS wm FROM c WHERE month <= {month}),
  o{month + 1} AS (SELECT s.* FROM s{month} s JOIN w{month} w ON s.b > w.wm)""")
        closed.append(f"SELECT s.* FROM s{month} s JOIN w{month} w ON s.b <= w.wm")
    return f"{ARRIVED}, {', '.join(steps)} SELECT client_id, a // 1000000 AS start, CAST(n AS BIGINT) AS n FROM ({' UNION ALL '.join(closed)}) q"


@query("stream_session_pass", _sessions_sql(1_800_000_000))
def stream_session_pass(t: Tables) -> DataFrame:
    return arriving(t, lambda rows: streams.sessions(rows.where("client_id IS NOT NULL"), "30 minutes", "client_id")).select("client_id", seconds("start"), "n")


@query("stream_stateful_replay")
def stream_stateful_replay(t: Tables) -> DataFrame:
    events = streams.replay(t.spark, f"{t.sf_dir}/events.parquet")
    pool = streams.slot_pool(events, "event_type", 20, 3600.0)
    return streams.drained(pool, place(t, "stream"))


@query("stream_stateful_coverage", "SELECT CAST(user_id AS BIGINT) AS user_id, CAST(edge AS BIGINT) AS edge, COUNT(*) AS entries FROM (SELECT user_id, edge, LAG(edge) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, event_id % 5 AS edge FROM events) e) q WHERE before IS NULL OR before <> edge GROUP BY 1, 2")
def stream_stateful_coverage(t: Tables) -> DataFrame:
    events = streams.replay(t.spark, f"{t.sf_dir}/events.parquet").withColumn("edge", F.col("event_id") % 5)
    return streams.drained(streams.fresh_entries(events, "user_id", "edge"), place(t, "stream"))


@query("stream_dedup_latest", f"{ARRIVED} SELECT DISTINCT click_id, us FROM r WHERE us > wm")
def stream_dedup_latest(t: Tables) -> DataFrame:
    return arriving(t, lambda rows: streams.once(rows.select("click_id", "ts"), "click_id")).select("click_id", F.unix_micros("ts").alias("us"))


@query("stream_debounce", f"""{ARRIVED} SELECT client_id, click_id, us FROM (SELECT *, LEAD(us) OVER (PARTITION BY client_id ORDER BY us, click_id) AS next FROM r WHERE us > wm AND client_id IS NOT NULL) q
  WHERE (next IS NULL OR next - us >= 1800000000) AND us + 1800000000 <= last""")
def stream_debounce(t: Tables) -> DataFrame:
    return arriving(t, lambda rows: streams.settled_events(rows.where("client_id IS NOT NULL"), 1800, "client_id", "click_id"))


@query("stream_throttle_bucket", "SELECT event_id FROM (SELECT event_id, b, LAG(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM (SELECT *, CAST(FLOOR(EPOCH(ts) / 1800) AS BIGINT) AS b FROM events) e) q WHERE p IS NULL OR p <> b")
def stream_throttle_bucket(t: Tables) -> DataFrame:
    b = t.events.withColumn("b", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800))
    p = F.lag("b").over(sequence.over("user_id", "ts", "event_id"))
    return b.withColumn("p", p).where("p IS NULL OR p <> b").select("event_id")


@query("stream_wrap_clock", "SELECT trip_id, shift FROM (SELECT trip_id, 0 AS shift FROM v_trips UNION ALL SELECT trip_id, -1440 FROM v_trips WHERE pu_min + dur_min > 1440) q")
def stream_wrap_clock(t: Tables) -> DataFrame:
    late = F.when(F.col("pu_min") + F.col("dur_min") > 1440, F.array(F.lit(0), F.lit(-1440))).otherwise(F.array(F.lit(0)))
    return t.trips.select("trip_id", F.explode(late).alias("shift"))
