"""Media columns: payloads in tar shards, found by digest, offset and length.

`write_shards` stores each text as a lossless 8-bit grey PNG named by the payload's SHA-256 in a tar shard of the writing
task; a row carries its shard, offset and length. `read_headers` fills width, height and bit depth from a range read of the
PNG's first bytes alone; `read_media` reads whole members and derives digests and a perceptual feature from the samples.

Scale: no shuffle of texts. A task keeps one copy of each payload in its own shard, so a group of copies, however large,
costs its task one member; rows are dealt by (shard, block) for reading, so a task reads neighbouring members. A shard's
name holds a fresh id for each attempt, and only the rows of the attempt that succeeded point at it.

Defined cases: a null or empty text is one block of 255s; repeated rows point at one member; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Samples in a row of the image; a payload is padded to a positive multiple of it.
WIDTH = 576
PAD = 255
SHARD_BYTES = 256 << 20
#: Signature, IHDR chunk: all that a header read needs.
HEADER_BYTES = 33
#: Rows of one read task's block within a shard.
BLOCK_BYTES = 4 << 20
MAGIC = b"\x89PNG\r\n\x1a\n"

INDEX = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
INDEX_DDL = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def padded(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (WIDTH * max(1, -(-len(raw) // WIDTH)) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey image of WIDTH columns whose samples are the payload; the same bytes for the same payload."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 3)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER_BYTES bytes."""
    if head[:8] != MAGIC or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def decode_png(image: bytes) -> bytes:
    width, height, _ = png_header(image)
    at, data = 8, []
    while at < len(image):
        (size,) = struct.unpack(">I", image[at : at + 4])
        if image[at + 4 : at + 8] == b"IDAT":
            data.append(image[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """A 64-bit average hash: whether each of 64 equal cells of samples lies above their mean."""
    cells = np.frombuffer(payload, np.uint8).reshape(64, -1).sum(axis=1, dtype=np.int64)
    return np.packbits(cells * 64 > cells.sum()).tobytes().hex()


class _Shards:
    """The tar shards of one task attempt."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path, recursive=True)
        self.out = None
        self.at = 0

    def add(self, name: str, body: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at + len(body) + 1024 > SHARD_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}")
        info = tarfile.TarInfo(f"{name}.png")
        info.size = len(body)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + body + bytes(-len(body) % 512))
        found = self.name, self.at + len(head), len(body)
        self.at += len(head) + len(body) + -len(body) % 512
        return found

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()


def write_shards(docs: DataFrame, uri: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the payload of every row to tar shards below uri and returns the index rows, stored."""

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(uri)
        known: dict[bytes, tuple[str, int, int]] = {}
        for part in parts:
            rows = []
            for i, raw in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                raw = raw.as_buffer().to_pybytes() if raw.is_valid else b""
                payload = padded(raw)
                digest = hashlib.sha256(payload)
                where = known.get(digest.digest())
                if where is None:
                    where = known[digest.digest()] = shards.add(digest.hexdigest(), encode_png(payload))
                rows.append((i, len(raw), digest.hexdigest(), *where))
            if len(known) > 500_000:  # a payload may then be stored once more; rows stay right
                known.clear()
            if rows:
                yield common.record_batch(INDEX, rows)
        shards.close()

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return common.stored(chosen.mapInArrow(write, INDEX_DDL), "media-index")


class _Reader:
    """Range reads with a few shards held open."""

    def __init__(self, uri: str, most: int = 16) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.most = most

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard not in self.open:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
            self.open[shard] = self.fs.open_input_file(f"{self.path}/{shard}")
        self.open.move_to_end(shard)
        return self.open[shard].read_at(length, offset)


def _dealt(index: DataFrame) -> DataFrame:
    return index.repartition("shard", F.floor(F.col("offset") / BLOCK_BYTES)).sortWithinPartitions("shard", "offset")


def _added(index: DataFrame, uri: str, names: list[tuple[str, pa.DataType, str]], derive) -> DataFrame:
    """Index rows with the columns that derive(reader, shard, offset, length) gives; a run of rows on one member reads once."""
    schema = pa.schema([*((f.name, t) for f, t in zip(index.schema, [x.type for x in _arrow(index)], strict=True)), *((n, t) for n, t, _ in names)])
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in index.schema), *(f"{n} {d}" for n, _, d in names)])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, got = _Reader(uri), None, ()
        for part in parts:
            if not part.num_rows:
                continue
            new = []
            for key in zip(*(part.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if key != last:
                    last, got = key, derive(reader, *key)
                new.append(got)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, (_, t, _) in zip(zip(*new, strict=True), names, strict=True))], schema=schema)

    return index.mapInArrow(add, ddl)


def _arrow(index: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(index.schema)


def read_headers(index: DataFrame, uri: str) -> DataFrame:
    """Width, height and bit depth by range reads of HEADER_BYTES bytes each."""
    names = [("width", pa.int64(), "long"), ("height", pa.int64(), "long"), ("bit_depth", pa.int64(), "long")]
    return _added(index, uri, names, lambda r, shard, offset, length: png_header(r.read(shard, offset, min(length, HEADER_BYTES))))


def _features(reader: _Reader, shard: str, offset: int, length: int) -> tuple:
    image = reader.read(shard, offset, length)
    payload = decode_png(image)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)


def read_media(index: DataFrame, uri: str) -> DataFrame:
    """Payload and image digests and the feature, from the stored bytes."""
    names = [("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string")]
    return _added(index, uri, names, _features)


def media_columns(docs: DataFrame) -> DataFrame:
    """All of it: stores every text, fills the metadata from headers, then reads the payloads back."""
    spark = common.prepare(docs.sparkSession)
    uri = common.scratch(spark, "media")
    index = _dealt(write_shards(docs, uri))
    return read_media(read_headers(index, uri), uri)


def op1_media_columns(spark, sf_dir: str) -> DataFrame:
    out = media_columns(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth")
