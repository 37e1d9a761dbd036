"""Streaming forms over events(ts timestamp, ...). Late rows beyond the watermark are dropped.

A row is late if what it would change ended at or before the watermark that all earlier starts have set: the largest event
time that they read, in whole milliseconds, less the delay. For windows that is the window's end, for sessions the row's own
time and the gap, for other operators the row's time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

LATE = "10 minutes"
STEP_ROWS = 100_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(spark: SparkSession, path: str, at: str = "ts") -> DataFrame:
    """A Parquet table as a stream of its files, its time column fit for watermarks."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)
    return stream.withColumn(at, F.col(at).cast("timestamp"))


def drained(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that a stream gives for what is there now, written as Parquet below the checkpoint and read back."""
    path = f"{checkpoint.rstrip('/')}/out"
    q = stream.writeStream.format("parquet").option("path", path).outputMode(mode).option("checkpointLocation", f"{checkpoint.rstrip('/')}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def arriving(table: DataFrame, period: str, build: Callable[[DataFrame], DataFrame], folder: str, at: str = "ts") -> DataFrame:
    """What the stream build(rows) appends when the table's rows arrive period by period, in order: for each period its rows
    are landed as files, and the query is started on the one checkpoint, reads what is new and stops. State is in RocksDB.

    Restarts are thus part of every run. Windows that the last watermark has not closed stay in the state."""
    spark = table.sparkSession
    landing, provider = f"{folder.rstrip('/')}/in", "spark.sql.streaming.stateStore.providerClass"
    rows = table.drop(period)
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:
        out = None
        for (now,) in sorted(table.select(period).distinct().collect()):
            table.where(F.col(period) == now).select(*rows.columns).write.mode("append").parquet(landing)
            live = spark.readStream.schema(rows.schema).parquet(landing).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, LATE)
            out = drained(build(live), folder)
        return table.limit(0) if out is None else out
    finally:
        spark.conf.set(provider, before)


def tumbling(events: DataFrame, size: str, *keys: str) -> DataFrame:
    """Counts of tumbling windows."""
    return events.groupBy(F.window("ts", size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, size: str, slide: str) -> DataFrame:
    return events.groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, key: str) -> DataFrame:
    """One row for each run of a key's events less than `gap` apart."""
    s = events.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def debounced(events: DataFrame, gap: str, key: str) -> DataFrame:
    """The last event of each session."""
    s = events.groupBy(F.session_window("ts", gap), key).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return s.select(key, "event_id")


def once(events: DataFrame, key: str) -> DataFrame:
    """The first row of each key; repeats are known until the watermark has passed the row's time by the delay."""
    return events.dropDuplicatesWithinWatermark([key])


class Debouncer(StatefulProcessor):
    """Emits an event once the watermark is `gap_us` past it and no other event of its key came within the gap after it.

    The state is what is undecided: events at least a gap apart, each with a timer."""

    def __init__(self, key: str, event: str, gap_us: int) -> None:
        self.key, self.event, self.gap = key, event, gap_us

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us long, event long")

    def due(self, us: int) -> int:
        return -(-(us + self.gap) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = [tuple(x) for x in self.pending.get()]
        new = [x for part in rows for x in zip(part["us"].tolist(), part[self.event].tolist(), strict=True)]
        all_ = sorted(old + new)
        kept = [x for x, y in zip(all_, [*all_[1:], None], strict=True) if y is None or y[0] - x[0] >= self.gap]
        for us, _ in set(old) - set(kept):
            self.handle.deleteTimer(self.due(us))
        for us, _ in kept:
            self.handle.registerTimer(self.due(us))
        self.pending.put(kept)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        all_ = [tuple(x) for x in self.pending.get()]
        ready = [x for x in all_ if self.due(x[0]) == now]
        if left := [x for x in all_ if self.due(x[0]) != now]:
            self.pending.put(left)
        else:
            self.pending.clear()
        yield pd.DataFrame({self.key: [key[0]] * len(ready), self.event: [e for _, e in ready], "us": [us for us, _ in ready]})

    def close(self) -> None:
        pass


def settled_events(events: DataFrame, gap_s: int, key: str, event: str = "event_id") -> DataFrame:
    """(key, event, us): debounced events of a stream, by event-time timers."""
    rows = events.select(key, "ts", F.col(event).cast("long").alias(event), F.unix_micros("ts").alias("us"))
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(Debouncer(key, event, gap_s * 1_000_000), f"{key} {kind}, {event} long, us long", "Append", "EventTime")


def latest(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def fresh_entries(events: DataFrame, key: str, edge: str) -> DataFrame:
    """(key, edge, entries) as events come: an edge counts when it differs from the key's last one, which is the state."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        found: dict[int, int] = {}
        for e in rows[edge]:
            if e != last:
                found[e] = found.get(e, 0) + 1
            last = e
        state.update((int(last),))
        yield pd.DataFrame({key: [k[0]] * len(found), edge: list(found), "entries": list(found.values())})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {edge} long, entries long", "last long", "append", "NoTimeout")


def slot_pool(events: DataFrame, zone: str, slots: int, stay_s: float) -> DataFrame:
    """Admits events into a zone's slots for stay_s seconds; (zone, event_id, admitted). The state is the times when slots
    get free; times past are forgotten, so it holds `slots` numbers at most. A task holds times and ids of a zone's new events,
    and gives them back in runs of STEP_ROWS."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        busy = list(state.get[0]) if state.exists else []
        us, ids = (np.concatenate(c) for c in zip(*((p["us"].to_numpy(), p["event_id"].to_numpy()) for p in parts), strict=True))
        order = np.lexsort((ids, us))
        for at in range(0, len(order), STEP_ROWS):
            some = order[at : at + STEP_ROWS]
            admitted = np.zeros(len(some), bool)
            for i, now in enumerate((us[some] / 1e6).tolist()):
                if busy and busy[0] <= now:
                    busy = [b for b in busy if b > now]
                if len(busy) < slots:
                    admitted[i] = True
                    busy.append(now + stay_s)  # the latest: in order
            yield pd.DataFrame({zone: k[0], "event_id": ids[some], "admitted": admitted})
        state.update((busy,))

    kind = events.schema[zone].dataType.simpleString()
    rows = events.select(zone, F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"))
    return rows.groupBy(zone).applyInPandasWithState(step, f"{zone} {kind}, event_id long, admitted boolean", "busy array<double>", "append", "NoTimeout")
