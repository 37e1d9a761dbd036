"""Records of large JSON documents, read in parts: one document is read by many tasks.

A task that begins in the middle of a document knows neither how deep it is nor whether it stands in a string. So two passes
are made. The first, a data source with a partition for each byte range, sums each range up for both cases: whether its quotes
change the case, by how much its brackets change the depth, and at each depth whether the last bracket that opened was the
wanted container's. A file's sums, a row a range, are chained in order; then every range's begin is known, and the second pass
yields the records that begin in each range, reading on to the end of the last one.

Containers: `at` names the array below the root whose objects are the records (`features`, `elements`); ARRAY is the root
itself; ENTRIES is a root object whose members are the records, with their keys. A file may hold several documents one after
another. Escapes are resolved at the ranges' bounds. Files are opened by pyarrow: local or in a store that it knows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ARRAY, ENTRIES = "[]", "{}"
#: Bytes of a range; bytes before it in which a key is sought.
RANGE, BEFORE = 16 << 20, 64 << 10
_SUMS = "file string, start long, stop long, flips int, up_outside long, up_inside long, last_outside map<int,boolean>, last_inside map<int,boolean>"
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.DOTALL)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """The documents of a file or folder with their sizes; what begins with _ or . is none."""
    path = path.rstrip("/")
    store, at = opened(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else "file://"
    info = store.get_file_info(at)
    found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "_.")


class Part:
    """Bytes of a file from `start` on, with what lies before them as far as it matters."""

    def __init__(self, stream: pa.NativeFile, start: int, stop: int, at: str) -> None:
        self.at, self.start = at, start
        back = min(start, BEFORE)
        data = stream.read_at(stop - start + back, start - back)
        self.before, self.data = data[:back], data[back:]
        raw = np.frombuffer(self.data, np.uint8)
        quotes = np.flatnonzero(raw == 34)
        slashed = quotes[(quotes == 0) | (raw[quotes - 1] == 92)] if len(quotes) else quotes
        escaped = [q for q in slashed.tolist() if self._slashes(q) % 2]
        self.quotes = np.setdiff1d(quotes, escaped, assume_unique=True) if escaped else quotes
        opens, closes = (raw == 123) | (raw == 91), (raw == 125) | (raw == 93)
        self.brackets = np.flatnonzero(opens | closes)
        self.steps = np.where(opens[self.brackets], 1, -1)
        self.odd = np.searchsorted(self.quotes, self.brackets) % 2
        self.kinds = raw[self.brackets]
        self.named = self._named() if at not in (ARRAY, ENTRIES) else np.zeros(0, np.int64)

    def _slashes(self, q: int) -> int:
        n = 0
        while (self.data[q - n - 1 : q - n] if q - n > 0 else self.before[len(self.before) + q - n - 1 : len(self.before) + q - n]) == b"\\":
            n += 1
        return n

    def _named(self) -> np.ndarray:
        """Where the wanted array may open: a bracket after its key."""
        key = re.compile(rb'"' + re.escape(self.at.encode()) + rb'"\s*:\s*\[')
        return np.array([m.end() - 1 - len(self.before) for m in key.finditer(self.before + self.data) if m.end() > len(self.before)], np.int64)

    def outside(self, in_string: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Brackets that stand in no string: places, kinds, steps, and the depth before each, from that at the begin."""
        kept = self.odd == in_string
        steps = self.steps[kept]
        return self.brackets[kept], self.kinds[kept], steps, np.cumsum(steps) - steps

    def wanted(self, places: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Which opening brackets may be the container's."""
        if self.at == ARRAY:
            return kinds == 91
        return kinds == 123 if self.at == ENTRIES else np.isin(places, self.named)

    def sums(self) -> tuple:
        out = []
        for case in (0, 1):
            places, kinds, steps, depth = self.outside(case)
            up = steps > 0
            last = dict(zip(depth[up].tolist(), self.wanted(places[up], kinds[up]).tolist(), strict=True))
            out.append((int(steps.sum()), last))
        return len(self.quotes) % 2, out[0][0], out[1][0], out[0][1], out[1][1]

    def records(self, in_string: int, depth: int, inside: bool, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end (0 where it isn't reached) of the records that begin in the part; level: depth of the records."""
        places, kinds, steps, before = self.outside(in_string)
        before = before + depth
        container = (before == level - 1) & (steps > 0)
        at, good = places[container], self.wanted(places[container], kinds[container])
        begins = places[(before == level) & (kinds == 123)]
        which = np.searchsorted(at, begins) - 1
        begins = begins[np.where(which >= 0, good[which], inside) if len(at) else np.full(len(begins), inside)]
        ends = places[(before == level + 1) & (steps < 0)]
        found = np.searchsorted(ends, begins)
        return begins, np.where(found < len(ends), ends[np.minimum(found, len(ends) - 1)] + 1 if len(ends) else 0, 0)

    def key(self, begin: int) -> str | None:
        m = _KEY.search((self.before + self.data[:begin])[-BEFORE:] if begin < BEFORE else self.data[begin - BEFORE : begin])
        return None if m is None else json.loads(b'"' + m[1] + b'"')


class _Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int) -> None:
        self.file, self.start, self.stop = file, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.at, self.size = options["path"], options["at"], int(options["range"])

    def partitions(self) -> list[_Range]:
        return [_Range(f, start, min(n, start + self.size)) for f, n in files(self.path) for start in range(0, n, self.size)]

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        if partition is None:  # no bytes at all
            return
        store, at = opened(partition.file)
        with store.open_input_file(at) as stream:
            yield (partition.file, partition.start, partition.stop, *Part(stream, partition.start, partition.stop, self.at).sums())


class JsonRanges(DataSource):
    """The sums of byte ranges of JSON files: spark.read.format("json_ranges") with the options path, at and range."""

    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        return _SUMS

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Reader(self.options)


def _level(at: str) -> int:
    return 1 if at in (ARRAY, ENTRIES) else 2


def begun(sums: DataFrame, at: str) -> DataFrame:
    """Each range with the case, the depth and the container at its begin: a file's ranges, a row each, are chained in order."""
    level = _level(at)

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        case, depth, inside, out = 0, 0, False, []
        for r in rows.sort_values("start").to_dict("records"):
            out.append((r["file"], r["start"], r["stop"], case, depth, inside))
            up, last = (r["up_outside"], r["last_outside"]) if case == 0 else (r["up_inside"], r["last_inside"])
            inside = bool(dict(last).get(level - 1 - depth, inside))
            case, depth = (case + r["flips"]) % 2, depth + up
        return pd.DataFrame(out, columns=["file", "start", "stop", "in_string", "depth", "inside"])

    return sums.groupBy("file").applyInPandas(chain, "file string, start long, stop long, in_string int, depth long, inside boolean")


def json_records(spark: SparkSession, path: str, at: str = ARRAY, size: int = RANGE) -> DataFrame:
    """(file, place, key, value): the records of a JSON file or folder, value as JSON text, place the byte at which it begins
    (so it orders a file's records), key null but for ENTRIES."""
    spark.dataSource.register(JsonRanges)
    sums = spark.read.format("json_ranges").option("path", path).option("at", at).option("range", size).load()
    level = _level(at)
    schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("key", pa.string()), ("value", pa.string())])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file, start, stop, in_string, depth, inside in zip(*(c.to_pylist() for c in part.columns), strict=True):
                store, where = opened(file)
                with store.open_input_file(where) as stream:
                    n, more = stream.size(), stop
                    while True:  # on until the last record that begins in the range has ended
                        own = Part(stream, start, more, at)
                        begins, ends = own.records(in_string, depth, inside, level)
                        mine = begins < stop - start
                        if more >= n or ends[mine].all():
                            break
                        more = min(n, more + max(1 << 20, more - start))
                ends = np.where(ends == 0, len(own.data), ends)
                spans = list(zip(begins[mine].tolist(), ends[mine].tolist(), strict=True))
                for low, high in pairwise([*range(0, len(spans), 4000), len(spans)]):
                    some = spans[low:high]
                    keys = [own.key(b) if at == ENTRIES else None for b, _ in some]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(some), pa.string()), pa.array([start + b for b, _ in some], pa.int64()), pa.array(keys, pa.string()), pa.array([own.data[b:e].decode("utf-8", "replace") for b, e in some], pa.string())], schema=schema)

    dealt = begun(sums, at).repartition(max(1, sum(-(-n // size) for _, n in files(path))), "file", "start")
    return dealt.mapInArrow(read, "file string, place long, key string, value string")
