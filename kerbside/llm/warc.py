"""WARC archives with an external index merge.

Pages are written as gzip-per-record WARC files; of equal payloads that of the smallest page_id is a response, the others
revisit it. Each task keeps the index rows of what it wrote and emits them in runs sorted by (URL key, timestamp, page_id).
Records are read back archive by archive, each task in the order of its files: one range read and one gunzip for each.
Runs are then dealt by key ranges, and each range merges its slices of all runs with a loser tree: the result is one globally
ordered capture history. The merge is external: beyond HELD rows a range's slices are merged into one sorted file in the shared
folder, and the tree reads such files a batch at a time, at most FAN_IN of them: while there are more, the oldest FAN_IN become
one. So neither memory nor open files grow with a range or with the number of runs. What is read back is stored before it is
dealt, so that sampling the ranges parses no record again.

Scale: digests travel first (one small row for each page, aggregated by digest with map-side combine); a page's html is
shuffled once, by page_id and digest, to meet its record type; index rows are dealt by range, with page_id in the key, so a host or url
with a third of all pages is spread over ranges. A run is cut at RUN_ROWS rows, so writing holds a bounded index. Archive files carry a fresh name for each attempt, and only rows of the attempt
that succeeded point at them.

Defined cases: a null html is empty; a null url has the key `-`; rows that repeat a page_id and its payload are alike, all
responses or all revisits; a null page_id is never a response while another page has the payload; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .media import _Reader

FILE_BYTES = 1 << 30
RUN_ROWS = 100_000
#: Rows of runs that a merge holds before it writes them; rows of a written run that it reads at a time.
HELD, READ_ROWS = 200_000, 1_000
#: Files that a merge reads at once; more are merged into fewer first.
FAN_IN = 64
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)

INDEX = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
INDEX_DDL = "run string, url_key string, ts long, page_id long, url string, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """The url with its host's labels reversed, in lower case, without scheme, port 80/443, leading www and fragment."""
    m = re.match(r"(?s)^[^:/?#]*://([^/?#]*)([^#]*)", url or "")
    if not m:
        return (url or "-").lower()
    host = m[1].rpartition("@")[2].lower()
    host = re.sub(r":(80|443)?$", "", host).removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


def stamp(page_id: int | None) -> int:
    """Seconds since EPOCH of a capture; pages carry no time, so their number stands for it."""
    return abs(page_id or 0) % (10 * 365 * 86400)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    date = (EPOCH + timedelta(seconds=stamp(page_id))).strftime("%Y-%m-%dT%H:%M:%SZ")
    target = re.sub(r"[\r\n]", lambda c: f"%{ord(c[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}')}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}')}>", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(body: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(body) + z.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzipped record."""
    body = zlib.decompress(raw, 31)
    head, _, rest = body.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def typed(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with `revisit` and `refers_to`."""
    pages = pages.select("page_id", "url", "html").withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    keyed = pages.select("page_id", "digest")
    groups = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    later = keyed.join(groups, "digest").where("NOT page_id <=> first").groupBy(F.col("page_id").alias("later"), F.col("digest").alias("later_digest")).agg(F.max("first").alias("refers_to"))
    later = later.withColumn("revisit", F.lit(True))
    return pages.join(later, F.expr("page_id <=> later AND digest = later_digest"), "left").select("page_id", "url", "html", F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers_to")


class _Files:
    def __init__(self, uri: str) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path, recursive=True)
        self.out, self.at, self.name = None, 0, ""

    def add(self, body: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at + len(body) > FILE_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
            info = b"software: kerbside\r\n"
            self.at = self.out.write(gzipped(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
        self.out.write(body)
        self.at += len(body)
        return self.name, self.at - len(body), len(body)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def write_archives(pages: DataFrame, uri: str) -> DataFrame:
    """Writes typed pages below uri; the stored index rows, in sorted runs."""

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(uri)
        held: list[tuple] = []

        def run() -> Iterator[pa.RecordBatch]:
            name = uuid.uuid4().hex
            held.sort(key=lambda r: order(*r[:3]))
            yield from common.batches(INDEX, ((name, *r) for r in held))
            held.clear()

        for part in parts:
            for page, url, html, revisit, refers in zip(*(c.to_pylist() for c in part.columns), strict=True):
                payload = (html or "").encode()
                where = files.add(gzipped(record(page, url, payload, sha1_base32(payload), refers, revisit)))
                held.append((url_key(url), stamp(page), page, url, *where))
                if len(held) >= RUN_ROWS:
                    yield from run()
        if held:
            yield from run()
        files.close()

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), "revisit", "refers_to")
    return common.stored(chosen.mapInArrow(write, INDEX_DDL), "warc-runs")


def order(key: str, ts: int, page: int | None) -> tuple:
    """Spark's order: by bytes, nulls first."""
    return key.encode(), ts, page is not None, page or 0


class LoserTree:
    """Merges sorted runs: a leaf for each run, each inner node the loser of its match, the winner above them."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k else -1

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return (x[0], a) < (y[0], b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            i = self.winner
            self.heads[i] = next(self.runs[i], None)
            node = (i + self.k) // 2
            while node:
                if self._less(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


class _Runs:
    """Rows of several runs as they come: whatever breaks a run's order begins another, and beyond HELD rows all go to disk."""

    def __init__(self, uri: str, schema: pa.Schema) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.schema, self.size = schema, 0
        self.open: dict[str, list[tuple]] = {}
        self.full: list[list[tuple]] = []
        self.files: list[str] = []
        self.at = [schema.names.index(n) for n in ("url_key", "ts", "page_id")]

    def key(self, row: tuple) -> tuple:
        return order(*(row[i] for i in self.at))

    def add(self, row: tuple) -> None:
        held = self.open.setdefault(row[0], [])
        if held and self.key(held[-1]) > self.key(row):
            self.full.append(held)
            held = self.open[row[0]] = []
        held.append(row)
        self.size += 1
        if self.size >= HELD:
            self.files.append(self._write(row for _, row in LoserTree(self._held())))
            self.open, self.full, self.size = {}, [], 0

    def _held(self) -> list[Iterator[tuple]]:
        return [((self.key(r), r) for r in run) for run in [*self.full, *self.open.values()]]

    def _write(self, rows: Iterator[tuple]) -> str:
        self.fs.create_dir(self.path, recursive=True)
        name = f"{self.path}/{uuid.uuid4().hex}.arrow"
        with self.fs.open_output_stream(name) as out, pa.ipc.new_stream(out, self.schema) as writer:
            for batch in common.batches(self.schema, rows, READ_ROWS):
                writer.write_batch(batch)
        return name

    def _read(self, name: str) -> Iterator[tuple]:
        with self.fs.open_input_stream(name) as file, pa.ipc.open_stream(file) as reader:
            for batch in reader:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield self.key(row), row

    def merge(self) -> Iterator[tuple]:
        while len(self.files) > FAN_IN:
            some, self.files = self.files[:FAN_IN], self.files[FAN_IN:]
            self.files.append(self._write(row for _, row in LoserTree([*map(self._read, some)])))
            self._delete(some)
        for _, row in LoserTree([*self._held(), *map(self._read, self.files)]):
            yield row
        self._delete(self.files)

    def _delete(self, names: list[str]) -> None:
        for name in names:
            self.fs.delete_file(name)


def merged(index: DataFrame, schema: pa.Schema = INDEX) -> DataFrame:
    """Rows of sorted runs (run, url_key, ts, page_id, ...) in global order: partition after partition, and within each."""
    uri = common.scratch(index.sparkSession, "warc-merge")

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(uri, schema)
        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                runs.add(row)
        yield from common.batches(schema, runs.merge())

    n = common.n_parts(index.sparkSession)
    return index.select(*schema.names).repartitionByRange(n, "url_key", "ts", "page_id").mapInArrow(merge, index.select(*schema.names).schema)


READ = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
READ_DDL = "run string, url_key string, ts long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(index: DataFrame, uri: str) -> DataFrame:
    """One row for each index row, in its order, from the stored record; a response's digest and length are those of its
    payload."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(uri)
        for part in parts:
            rows = [tuple(r.values()) for r in part.select(["file", "offset", "length", "run", "url_key", "ts"]).to_pylist()]
            out: list[tuple] = [()] * len(rows)
            for i in sorted(range(len(rows)), key=lambda i: rows[i][:2]):
                file, offset, length, *own = rows[i]
                fields, payload = parse(reader.read(file, offset, length))
                number = lambda name, f=fields: int(f[name]) if f.get(name) else None
                if fields["WARC-Type"] == "response":
                    size, digest = len(payload), sha1_base32(payload)
                    if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"{file} at {offset}: payload digest differs")
                else:
                    size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                out[i] = *own, number("X-Page-ID"), size, digest, fields["WARC-Type"], number("X-Refers-To-Page-ID")
            if out:
                yield common.record_batch(READ, out)

    return index.mapInArrow(read, READ_DDL)


def archive(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, ts) of every page, in global order."""
    spark = common.prepare(pages.sparkSession)
    uri = common.scratch(spark, "warc")
    runs = write_archives(typed(pages), uri)
    read = common.stored(read_archives(runs, uri), "warc-read")
    return merged(read, READ).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return archive(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: DuckDB's rows: five hex digits of a digest make four base32 digits.
SQL = rf"""WITH typed AS (
    SELECT page_id, COALESCE(html, '') AS html, COALESCE(url, '') AS url, sha1(COALESCE(html, '')) AS hex, MIN(page_id) OVER (PARTITION BY COALESCE(html, '')) AS first FROM pages),
  parts AS (SELECT *, regexp_extract(url, '(?s)^[^:/?#]*://([^/?#]*)([^#]*)', 1) AS authority, regexp_extract(url, '(?s)^[^:/?#]*://([^/?#]*)([^#]*)', 2) AS rest,
    list_transform(range(0, 8), lambda g: list_reduce(list_transform(range(1, 6), lambda k: instr('0123456789abcdef', substr(hex, 5 * g + k, 1)) - 1), lambda x, y: x * 16 + y)) AS five FROM typed),
  hosts AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(authority, '(?s)^.*@', '')), ':(80|443)?$', ''), '^www[.]', '') AS host FROM parts)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(five, lambda v: array_to_string(list_transform(range(0, 4), lambda k: substr('{_BASE32}', CAST(v // CAST(POWER(32, 3 - k) AS BIGINT) % 32 + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  CASE WHEN regexp_matches(url, '^[^:/?#]*://') THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE lower(rest) END
    WHEN url = '' THEN '-' ELSE lower(url) END AS url_key,
  CAST(ABS(page_id) % (10 * 365 * 86400) AS BIGINT) AS ts FROM hosts"""
