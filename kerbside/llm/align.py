"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, relational in Spark.

`align` takes segments with their two token lists and is relational throughout: tokens are exploded with their positions,
windowed sums of their lengths give the byte at which each ends, the full equi-join of both sides on segment and end gives
the intervals between neighbouring ends, and running counts of the cuts (both end) number the groups. Two tokens overlap exactly
where they cover an interval together, and each overlapping pair shares one interval alone; so the range join of the links
comes down to carrying, back from the segment's end, the last id seen on either side, and no pair is made that is no link.

Documents are cut into chunks before each single space that follows no space and stands before no white space: both tokenizers
begin a token there (checked for the pieces on loading), so a chunk's tokens are those that it has in its document. A block
of about BLOCK characters of documents keeps each chunk once. Where tokens end decides what they overlap; so chunks whose tokens
have the same bytes, in order, are of one shape, and `align` sees each distinct shape of the corpus once, with the tokens'
positions for ids. It comes back to the blocks by their shapes, as the ends in order: the token that covers an interval is
the one after all that have ended, so each chunk puts its own ids in. A document with a chunk that is not given back is one chunk. Documents get their sums back from the chunks of
their block. An id pair counts once a document, which needs the pairs of each document together: these are counted block by
block, then over all blocks by an aggregate.

Scale: what a task holds is one block (or one document, if that is longer). Texts are never shuffled, only chunk numbers and
ids, as bytes. A shape's list of blocks has a number for each block that holds it.
A common chunk or a group of copies is one chunk in each block. Pair counts are partial in the blocks and joined back on
the pair: at most one row a block for any pair, and adaptive execution can split it.

Defined cases: a text that is null, empty or not given back by either tokenizer has zeros and ''; repeated rows, and rows
that repeat a doc_id or have none, are documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .pieces import SPACE

BYTES_MODEL, PIECES_MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed: how a byte-level vocabulary of this kind cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a block of documents; links that are sorted at a time when a block's pairs are counted.
BLOCK, SLICE = 11 << 20, 500_000
#: A token is one number: its id, and its bytes from this bit on. An interval too: A's id, B's id, whether A's token ends with
#: it, whether B's does.
BITS = 20
IDS = (1 << BITS) - 1
#: A shape's tokens are their positions, of this many bits.
POS_BITS = 30
#: Bits of a chunk's or shape's number within a block, and of a block's number within a task; chunks in one row.
CHUNK_BITS, BLOCK_BITS, BUNDLE = 28, 11, 256

_CUT = re.compile(r"(?<! ) (?=\S)")
_SPACES = re.compile(r" \s")


def _letter_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both vocabularies: ids of chunks, and each id's bytes."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            entries = json.load(f)
        letter = _letter_bytes()
        special = {t["content"] for t in entries["added_tokens"]}
        ranks = {bytes(letter[c] for c in entry): i for entry, i in entries["model"]["vocab"].items() if entry not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.a_bytes[i] = raw
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        none = [self.b.is_control(i) or self.b.is_unknown(i) for i in range(len(pieces))]
        if any(SPACE in p.lstrip(SPACE) for p, n in zip(pieces, none, strict=True) if not n):
            raise ValueError("chunks are not independent in this vocabulary")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if none[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int32)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int32)
        if max(len(self.a_len), len(self.b_len)) > IDS or max(self.a_len.max(), self.b_len.max()) >= 1 << (31 - BITS):
            raise ValueError("an id or a token is too long for its bits")

    def encode(self, chunks: list[str], step: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Steps of chunks (a space before each): A's ids one after the other and how many each chunk has, B's alike, and
        whether both give back the chunk's bytes."""
        for low in range(0, len(chunks), step):
            some = chunks[low : low + step]
            raw = [f" {c}".encode() for c in some]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            a, a_counts = self._a(some, sizes)
            pieces = self.b.encode(some, num_threads=1)
            b_counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
            flat = list(chain.from_iterable(pieces))
            b = np.array(flat, np.int32)
            same = np.ones(len(some), bool)
            given = np.diff(np.concatenate([[0], np.cumsum(self.b_len[b])])[np.concatenate([[0], np.cumsum(b_counts)])])
            if (given != sizes).any() or b"".join(map(self.b_bytes.__getitem__, flat)) != b"".join(raw):
                same = np.array([b"".join(map(self.b_bytes.__getitem__, p)) == r for p, r in zip(pieces, raw, strict=True)], bool)
            yield a, a_counts, b, b_counts, same

    def _a(self, chunks: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids. Chunks without white space at their begin or a space at their end are encoded in one go: A cuts between them."""
        apart = np.array([not c or c[0].isspace() or c[-1] == " " for c in chunks], bool)
        joined = np.array(self.a.encode_ordinary("".join([f" {c}" for c, alone in zip(chunks, apart.tolist(), strict=True) if not alone])), np.int32)
        ends = np.searchsorted(np.cumsum(self.a_len[joined]), np.cumsum(sizes[~apart]), side="left") + 1 if len(joined) else np.zeros(0, np.int64)
        counts = np.zeros(len(chunks), np.int64)
        counts[~apart] = np.diff(ends, prepend=0)
        if not apart.any():
            return joined, counts
        own = {k: np.array(self.a.encode_ordinary(f" {chunks[k]}"), np.int32) for k in np.flatnonzero(apart).tolist()}
        for k, ids in own.items():
            counts[k] = len(ids)
        upto = np.concatenate([[0], np.cumsum(np.where(apart, 0, counts))])
        return np.concatenate([own[k] if k in own else joined[upto[k] : upto[k + 1]] for k in range(len(chunks))]), counts


@cache
def tokenizers_of(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def _even(text: str) -> bool:
    """Whether every space begins a chunk."""
    return not (text[0] == " " or text[-1] == " " or _SPACES.search(text))


def chunks_of(text: str) -> list[str]:
    """The chunks of space+text, each without the space before it."""
    if _even(text):
        return text.split(" ")
    if text[0] == " ":
        first, *rest = _CUT.split(f" {text}")
        return [first[1:], *rest]
    return _CUT.split(text)


def numbered(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct chunks of texts, and for each text the numbers of its own."""
    even = [_even(t) for t in texts]
    split = pc.split_pattern(pa.array([t for t, e in zip(texts, even, strict=True) if e], pa.large_string()), " ")
    own = [chunks_of(t) for t, e in zip(texts, even, strict=True) if not e]
    values = pa.concat_arrays([split.flatten(), pa.array(list(chain.from_iterable(own)), pa.large_string())]).dictionary_encode()
    parts = iter(np.split(values.indices.to_numpy(), np.cumsum([*np.diff(split.offsets.to_numpy()), *map(len, own)])[:-1]) if texts else ())
    first = [next(parts) for e in even if e]
    rest = iter(parts)
    first = iter(first)
    return values.dictionary.to_pylist(), [next(first) if e else next(rest) for e in even]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


_INTS = pa.list_(pa.int32())
_CUT_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("chunks", pa.binary()), ("segment", pa.int64()), ("a_ids", pa.binary()), ("b_ids", pa.binary()), ("shapes", pa.binary()), ("a", _INTS), ("b", _INTS), ("kind", pa.int32())])
_CUT_DDL = "block long, doc_id long, chunks binary, segment long, a_ids binary, b_ids binary, shapes binary, a array<int>, b array<int>, kind int"


def _packed(lists: list[np.ndarray]) -> pa.Array:
    """Lists of ints as bytes: all lowest ones, then all second ones, and so on; the upper ones are mostly 0 and compress well."""
    return pa.array([np.ascontiguousarray(x, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes() for x in lists], pa.binary())


def _unpacked(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ints of all lists one after the other, and where each list begins and ends."""
    parts = [np.frombuffer(x, np.uint8).reshape(4, -1).T if x else np.zeros((0, 4), np.uint8) for x in column.to_pylist()]
    flat = np.ascontiguousarray(np.concatenate([np.zeros((0, 4), np.uint8), *parts])).view(np.int32).ravel()
    return flat, np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])


class _Shapes:
    """Numbers the shapes of chunks: the bytes of each of A's tokens and of each of B's."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def numbers(self, a: np.ndarray, a_counts: np.ndarray, b: np.ndarray, b_counts: np.ndarray) -> np.ndarray:
        """The number of each chunk's shape; a and b: the bytes of the chunks' tokens, which are short (Tokenizers sees to it)."""
        at = np.concatenate([[0], np.cumsum(2 + a_counts + b_counts)])
        begin = at[:-1]
        units = np.empty(at[-1], np.uint16)
        units[begin], units[begin + 1] = a_counts & 0xFFFF, a_counts >> 16
        units[_spread(begin + 2, a_counts)] = a
        units[_spread(begin + 2 + a_counts, b_counts)] = b
        keys = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at.astype(np.int64) * 2), pa.py_buffer(units)]).dictionary_encode()
        known = self.known
        return np.array([known.setdefault(k, len(known)) for k in keys.dictionary.to_pylist()], np.int32)[keys.indices.to_numpy()]

    def rows(self, step: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Steps of the shapes in order: A's bytes one after the other and how many tokens each has, B's alike."""
        keys = list(self.known)
        for low in range(0, len(keys), step):
            some = keys[low : low + step]
            units = np.frombuffer(b"".join(some), np.uint16).astype(np.int32)
            size = np.fromiter(map(len, some), np.int64, len(some)) // 2
            begin = np.cumsum(size) - size
            a_counts = (units[begin] + (units[begin + 1] << 16)).astype(np.int64)
            b_counts = size - 2 - a_counts
            yield units[_spread(begin + 2, a_counts)], a_counts, units[_spread(begin + 2 + a_counts, b_counts)], b_counts


def _cut(docs: DataFrame, a_path: str, b_path: str, block: int) -> DataFrame:
    """Rows of documents (kind 0; chunks: the numbers of their chunks in the block, none where there are no tokens), of the
    chunks of each block (kind 1; segment: block and number of the row's first, a_ids and b_ids of all, shapes: the number of
    each one's shape) and of the shapes of each block (kind 2; segment: block and number, a and b: bytes of each token)."""

    def closed(name: int, held: list[tuple[int | None, str | None]], both: Tokenizers) -> Iterator[pa.RecordBatch]:
        chunks, found = numbered([t for _, t in held if t])
        numbers = iter(found)
        docs = [(i, next(numbers) if t else None) for i, t in held]
        coded = list(both.encode(chunks))
        same = np.concatenate([np.zeros(0, bool), *(x[-1] for x in coded)])
        if not same.all():  # documents with a chunk that isn't given back are one chunk, without tokens if it isn't given back either
            for k, (i, own) in enumerate(docs):
                if own is not None and not same[own].all():
                    coded += both.encode([" ".join([chunks[c] for c in own.tolist()])])
                    docs[k] = i, np.array([len(chunks)], np.int32)
                    chunks.append("")
            same = np.concatenate([x[-1] for x in coded])
            place = (np.cumsum(same) - 1).astype(np.int32)
            docs = [(i, place[own] if own is not None and same[own].all() else None) for i, own in docs]
        low = 0
        while low < len(docs):
            high, n = low, 0
            while high < len(docs) and (high == low or n < 1 << 20) and high - low < 4000:
                n += 0 if docs[high][1] is None else len(docs[high][1])
                high += 1
            some = docs[low:high]
            yield batch(len(some), name, doc_id=pa.array([i for i, _ in some], pa.int64()), chunks=_packed([np.zeros(0, np.int32) if own is None else own for _, own in some]), kind=pa.array([0] * len(some), pa.int32()))
            low = high
        low, shapes = 0, _Shapes()
        for a, a_counts, b, b_counts, ok in coded:
            a, b = a[np.repeat(ok, a_counts)], b[np.repeat(ok, b_counts)]
            a_counts, b_counts = a_counts[ok], b_counts[ok]
            n = len(a_counts)
            if not n:
                continue
            begin = np.arange(0, n, BUNDLE)
            own = shapes.numbers(both.a_len[a], a_counts, both.b_len[b], b_counts)
            of_rows = lambda x, counts: _packed(np.split(x, np.cumsum(np.add.reduceat(counts, begin))[:-1]))  # noqa: B023, E731
            lists = {"a_ids": of_rows(a, a_counts), "b_ids": of_rows(b, b_counts), "shapes": of_rows(own, np.ones(n, np.int64))}
            yield batch(len(begin), name, segment=pa.array((name << CHUNK_BITS) + low + begin), **lists, kind=pa.array([1] * len(begin), pa.int32()))
            low += n
        low = 0
        for a, a_counts, b, b_counts in shapes.rows():
            n = len(a_counts)
            yield batch(n, name, segment=pa.array((name << CHUNK_BITS) + np.arange(low, low + n)), a=_lists(a, a_counts), b=_lists(b, b_counts), kind=pa.array([2] * n, pa.int32()))
            low += n

    def batch(n: int, name: int, **columns: pa.Array) -> pa.RecordBatch:
        columns["block"] = pa.array([name] * n, pa.int64())
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _CUT_ARROW], schema=_CUT_ARROW)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers_of(a_path, b_path)
        name, size = TaskContext.get().partitionId() << BLOCK_BITS, 0
        held: list[tuple[int | None, str | None]] = []
        for part in parts:
            for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                text = text.as_py()
                held.append((i, text))
                size += len(text or "")
                if size >= block:
                    yield from closed(name, held, both)
                    name, size, held = name + 1, 0, []
        if held:
            yield from closed(name, held, both)
        held = []
        common.give_back()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, _CUT_DDL)


def align(segments: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """segments(keys, a, b: tokens, id + 2^bits * bytes, of equal bytes together) -> one row for each interval between
    neighbouring ends: keys, end, group (the last of the segment is 1), a_id and b_id (of the token that ends there, else
    null), a_over and b_over (of the tokens that cover it: a link).

    The full equi-join on keys and end is a union and an aggregate: unlike Spark's full outer join it keeps the partitioning
    by keys, so one exchange of the segments by keys serves all windows. An end is met once on either side."""
    sides = F.array(F.struct(F.lit(True).alias("is_a"), F.col("a").alias("tokens")), F.struct(F.lit(False).alias("is_a"), F.col("b").alias("tokens")))
    both = segments.select(*keys, F.explode(sides).alias("side")).select(*keys, "side.is_a", F.posexplode("side.tokens").alias("pos", "token"))
    end = F.sum(F.shiftright("token", bits)).over(Window.partitionBy(*keys, "is_a").orderBy("pos"))
    ends = both.select(*keys, "is_a", end.alias("end"), F.col("token").bitwiseAND((1 << bits) - 1).alias("id"))
    met = ends.groupBy(*keys, "end").agg(F.max(F.when(F.col("is_a"), F.col("id"))).alias("a_id"), F.max(F.when(~F.col("is_a"), F.col("id"))).alias("b_id"))
    back = Window.partitionBy(*keys).orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return met.select(
        *keys,
        "end",
        F.count(F.when(F.col("a_id").isNotNull() & F.col("b_id").isNotNull(), 1)).over(back).alias("group"),
        "a_id",
        "b_id",
        F.last("a_id", ignorenulls=True).over(back).alias("a_over"),
        F.last("b_id", ignorenulls=True).over(back).alias("b_over"),
    )


def _aligned_shapes(cut: DataFrame) -> DataFrame:
    """Each block's shapes (segment: block and number) with their intervals in order, a digit each: 1 where a token of A ends, 2
    for B, 3 for both; a token covers the intervals up to its end, so its position is the number of ends before. Where tokens end decides
    what they overlap, so each distinct shape is aligned once, with the tokens' positions for ids; every shape of a block
    takes the intervals of its like."""
    alike = _compact(cut.where("kind = 2").groupBy("a", "b").agg(F.min("segment").alias("shape"), F.collect_list("segment").alias("segments")), "align-shapes")
    token = lambda c: F.transform(c, lambda n, i: i.cast("long") + F.shiftleft(n.cast("long"), POS_BITS)).alias(c)
    rows = align(alike.select("shape", token("a"), token("b")).repartition("shape"), ["shape"], POS_BITS)
    digit = F.when(F.col("a_id").isNull(), "2").when(F.col("b_id").isNull(), "1").otherwise("3")
    lists = rows.select("shape", F.struct("end", digit.alias("digit")).alias("x")).groupBy("shape").agg(F.array_join(F.sort_array(F.collect_list("x"))["digit"], "").alias("ends"))
    out = _compact(lists.join(alike.select("shape", "segments"), "shape").select(F.explode("segments").alias("segment"), "ends"), "align-intervals")
    common.discard(alike)
    return out


def _compact(df: DataFrame, name: str) -> DataFrame:
    """stored(), in a tighter encoding: these tables are read once or twice."""
    codec = "spark.sql.parquet.compression.codec"
    before = df.sparkSession.conf.get(codec)
    df.sparkSession.conf.set(codec, "zstd")
    try:
        return common.stored(df, name)
    finally:
        df.sparkSession.conf.set(codec, before)


def _spread(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    upto = np.cumsum(count)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(low - (upto - count), count)


class _Block:
    """The rows of one block: documents, aligned chunks and, in the second pass, counted pairs."""

    def __init__(self, table: pa.Table) -> None:
        kind = table.column("kind").to_numpy()
        docs, chunks, shapes, pairs = (table.filter(pa.array(kind == k)) for k in range(4))
        self.docs = pa.RecordBatch.from_struct_array(docs.column("doc").combine_chunks())
        self.own, self.own_at = _unpacked(self.docs.column("chunks"))
        self.codes, self.at = self._intervals(chunks.sort_by("segment"), shapes.sort_by("segment"))
        self.pairs = pa.RecordBatch.from_struct_array(pairs.column("pair").combine_chunks()) if "pair" in table.column_names else None

    def _intervals(self, chunks: pa.Table, shapes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of all chunks, and where those of each begin: its shape's, with its own ids for the positions."""
        (a, _), (b, _), (shape, _) = (_unpacked(chunks.column(c)) for c in ("a", "b", "shapes"))
        texts = shapes.column("ends").to_pylist()
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        n = np.diff(at)[shape]
        ends = (np.frombuffer("".join(texts).encode(), np.uint8) & 3)[_spread(at[:-1][shape], n)]
        of_a, of_b = ends & 1, ends >> 1  # a chunk ends with tokens of both, so positions go on from chunk to chunk
        out = ends.astype(np.int64) << 2 * BITS
        out += a[np.cumsum(of_a, dtype=np.int64) - of_a]
        out += b[np.cumsum(of_b, dtype=np.int64) - of_b].astype(np.int64) << BITS
        return out, np.concatenate([[0], np.cumsum(n)])

    def chunk_sums(self, of_interval: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(of_interval)])[self.at])

    def sums(self, of_interval: np.ndarray) -> pa.Array:
        """For each document, the sum over the intervals of its chunks."""
        return pa.array(self._sums(self.chunk_sums(of_interval)), pa.int64())

    def _sums(self, of_chunk: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(of_chunk[self.own])])[self.own_at])

    def texts(self) -> pa.Array:
        """Each chunk's groups, `a1,a2|b1;a3|b2`."""
        parts, groups, own_a, own_b = [pa.array([], pa.large_string())], [], [], []
        for chunk in range(0, len(self.at) - 1, 20_000):  # Python's own numbers take much memory
            at, out = self.at[chunk : chunk + 20_001], []
            codes = self.codes[at[0] : at[-1]]
            a, b, ends = (x.tolist() for x in (codes & IDS, (codes >> BITS) & IDS, codes >> 2 * BITS))
            for low, high in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True):
                for i in range(low, high):
                    end = ends[i]
                    if end & 1:
                        own_a.append(str(a[i]))
                    if end & 2:
                        own_b.append(str(b[i]))
                    if end == 3:
                        groups.append(f"{','.join(own_a)}|{','.join(own_b)}")
                        own_a, own_b = [], []
                out.append(";".join(groups))
                groups = []
            parts.append(pa.array(out, pa.large_string()))
        return pa.concat_arrays(parts)

    def digests(self) -> pa.Array:
        """For each document, the digest of its chunks' groups; '' without chunks."""
        texts, out, low = self.texts(), [], 0
        while low < len(self.docs):
            high = max(low + 1, int(np.searchsorted(self.own_at[1:], self.own_at[low] + SLICE, side="right")))
            at = self.own_at[low : high + 1]
            lists = pa.LargeListArray.from_arrays(pa.array(at - at[0]), texts.take(pa.array(self.own[at[0] : at[-1]])))
            out += [hashlib.sha256(x).hexdigest() if x else "" for x in pc.binary_join(lists, pa.scalar(";", pa.large_string())).cast(pa.large_binary()).to_pylist()]
            low = high
        return pa.array(out, pa.string())

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of the block, and how many of its documents hold each."""
        pairs, of_link = np.unique(self.codes & ((1 << 2 * BITS) - 1), return_inverse=True)
        links = np.diff(self.at)
        total = np.zeros(len(pairs), np.int64)
        n = self._sums(links)
        upto = np.cumsum(n)
        low = 0
        while low < len(n):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + SLICE, side="right")))
            own = self.own[self.own_at[low] : self.own_at[high]]
            keys = np.repeat(np.arange(high - low), n[low:high]) * len(pairs) + of_link[_spread(self.at[own], links[own])]
            keys.sort()
            new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
            total += np.bincount(keys[new] % max(1, len(pairs)), minlength=len(pairs))
            low = high
        return pairs, total


_FOLD_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("chunks", pa.binary()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pair", pa.int64()), ("n", pa.int64())])
_FOLD_DDL = "block long, doc_id long, chunks binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, n long"


def _fold(table: pa.Table) -> pa.Table:
    """Each document's row, and the pairs of the block with the number of documents that hold them."""
    b = _Block(table)
    digests = b.digests()
    pairs, n = b.pair_counts()
    name = table.column("block")[0].as_py()
    docs, more = len(b.docs), len(pairs)
    ends = b.codes >> 2 * BITS
    counts = [b.sums(x) for x in (ends & 1, ends >> 1, (ends == 3).astype(np.int64), np.ones(len(ends), np.int64))]
    rows = pa.Table.from_arrays([pa.array([name] * docs, pa.int64()), b.docs.column("doc_id"), b.docs.column("chunks"), *counts, digests, pa.nulls(docs, pa.int64()), pa.nulls(docs, pa.int64())], schema=_FOLD_ARROW)
    counted = pa.Table.from_arrays([pa.array([name] * more, pa.int64()), *(pa.nulls(more, f.type) for f in list(_FOLD_ARROW)[1:8]), pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], schema=_FOLD_ARROW)
    del b, ends
    common.give_back()  # blocks come one after the other in a worker
    return pa.concat_tables([rows, counted])


_RATE_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _rate(table: pa.Table) -> pa.Table:
    """Each document with the sums over its links of the pairs' counts in the corpus."""
    b = _Block(table)
    pair, count, best = (b.pairs.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    at = order[np.searchsorted(pair, b.codes & ((1 << 2 * BITS) - 1), sorter=order)]
    known = {c: b.docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    known |= {"n_best": b.sums(best[at].astype(np.int64)), "count_sum": b.sums(count[at])}
    del b, pair, count, best, order, at
    common.give_back()
    return pa.table({c.split()[0]: known[c.split()[0]] for c in _RATE_DDL.split(", ")})


def _rows(kind: int, types: dict[str, str], df: DataFrame, **columns) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), "block", *(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()))


def aligned(docs: DataFrame, a_path: str = BYTES_MODEL, b_path: str = PIECES_MODEL, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text) -> one row a document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    cut = _compact(_cut(docs, a_path, b_path, block), "align-cut")
    shapes = _aligned_shapes(cut).withColumn("block", F.shiftright("segment", CHUNK_BITS))
    lists = {"segment": "long", "a": "binary", "b": "binary", "shapes": "binary", "ends": "string"}

    def with_chunks(types: dict[str, str], docs: DataFrame) -> DataFrame:
        chunks = _rows(1, types, cut.where("kind = 1"), segment=F.col("segment"), a=F.col("a_ids"), b=F.col("b_ids"), shapes=F.col("shapes"))
        return docs.union(chunks).union(_rows(2, types, shapes, segment=F.col("segment"), ends=F.col("ends")))

    types = {"doc": "struct<doc_id:long,chunks:binary>"} | lists
    both = with_chunks(types, _rows(0, types, cut.where("kind = 0"), doc=F.struct("doc_id", "chunks")))
    folded = _compact(both.groupBy("block").applyInArrow(_fold, _FOLD_DDL), "align-fold")
    pairs = folded.where("pair IS NOT NULL").select("block", "pair", "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.col("pair").bitwiseAND(IDS))
    top = counts.groupBy("a").agg(F.max("n").alias("most"))
    marks = counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    counted = pairs.select("block", "pair").join(marks, "pair")
    numbers = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    types = {"doc": "struct<doc_id:long,chunks:binary,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>"} | lists | {"pair": "struct<pair:long,n:long,best:int>"}
    all_ = with_chunks(types, _rows(0, types, folded.where("pair IS NULL"), doc=F.struct("doc_id", "chunks", *numbers)))
    all_ = all_.union(_rows(3, types, counted, pair=F.struct("pair", "n", "best")))
    return all_.groupBy("block").applyInArrow(_rate, _RATE_DDL)


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return aligned(common.table(spark, sf_dir, "documents"))
