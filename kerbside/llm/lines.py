"""Line dedup by content-defined chunks of lines.

A line ends at a line break or after a sentence's end (in CJK also without a space); characters of scripts without spaces
count as words. Blank lines are passed over.

1. Boundaries. A rolling hash over the hashes of WINDOW lines deals each line to one of two families. A chunk runs from one
   boundary of a family to the next of the same family that gives it MIN_WORDS words; a line of LONG words or more is a chunk
   by itself and ends the others. Both families cut every text, and a boundary depends on its own lines alone; so whatever
   stands around a passage, its chunks are the same, and every run of whole lines with more than REACH words holds at least
   one whole chunk: without one it has at most 3 * (LONG - 1) + 2 * (MIN_WORDS - 1) = 48 words.
2. Repeats. A chunk is known by a rolling hash over its lines' hashes. Those that occur twice in all documents mark their own
   lines and those up to REACH words away, which is as far as a repeated passage can go on beyond its chunks.
3. Removal. Among the marked lines every shortest run with MIN_WORDS words that begins, or ends, with a line is compared byte
   by byte with its first occurrence (by doc_id, then the text's hash, then place); equal runs go. White space around a run is no
   part of it, white space within it is. An occurrence that overlaps the first of the same document is no repeat.

So a repeated passage of more than REACH words goes whole, ends included, wherever it stands. What stays: lines that repeat
only in part, runs under MIN_WORDS words, and shorter runs that hold no chunk.

Scale: 8 bytes a chunk are shuffled and counted with map-side combine; a bitmap of FILTER_BITS bits, a fixed size, tells the
second scan which chunks may repeat (if it is too small for a corpus, more runs are compared, and results stay the same). Only
marked runs travel as texts: each task compares its own first, HELD bytes at a time, and sends one of equal runs to the bucket
of its hash (BUCKETS for each shuffle partition), so that a hot run comes once for HELD bytes, and a bucket is compared in one
task. Whole texts are shuffled once, to be rewritten next to the places to remove.

Defined cases: a null text stays null, an empty one empty; rows with equal doc_id and text are one document and are rewritten
alike; a null doc_id comes first; a text may lose every line and is then empty; other columns are kept as they are, but input
columns named n_lines or removed_lines give way to those that are added; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .near import bitmap, spots
from .words import U, mix, powers, utf8

#: Words of a chunk, and of a run that goes, at least; words of a line that is a chunk by itself.
MIN_WORDS, LONG = 10, 11
#: Words around a repeated chunk that are looked at; lines in the rolling hash that sets boundaries.
REACH, WINDOW = 50, 2
#: Bytes of runs that a task compares before it sends them; buckets for each shuffle partition.
HELD, BUCKETS = 16 << 20, 4
_END = re.compile(r"\n+|[.!?]\s+|[。！？｡]+\s*")
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")


def lines(text: str) -> list[str]:
    """The text cut after each line's end; joined they are the text again."""
    cuts = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def n_words(own: list[str]) -> list[int]:
    """Each line's words."""
    out = [len(x.split()) for x in own]
    if any(not x.isascii() and _UNSPACED.search(x) for x in own):
        out = [max(n, len(_UNSPACED.findall(x))) for n, x in zip(out, own, strict=True)]
    return out


_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
#: First bytes of characters that may be white space, a line's end or of a script without spaces.
_WIDE = np.zeros(256, bool)
_WIDE[[0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, *range(0xF0, 0xF5)]] = True


class Lines:
    """The lines of some texts: where each begins and ends in their UTF-8, and arrays over those that are not blank."""

    def __init__(self, column: pa.Array) -> None:
        data, bounds = utf8(column)
        self.bytes = data.tobytes()
        low, high, bare, past, words, doc = self._cut(data, bounds)
        if odd := self._odd(data, bounds):
            kept = ~np.isin(doc, list(odd))
            parts = [np.stack([low, high, bare, past, words, doc])[:, kept], *(self._cut_text(d, int(bounds[d]), int(bounds[d + 1])) for d in odd)]
            low, high, bare, past, words, doc = (x := np.concatenate(parts, axis=1))[:, np.argsort(x[0], kind="stable")]
        self.low, self.high, self.words = low, high, words
        self.at = np.searchsorted(doc, np.arange(len(bounds)))  # each text's first line
        kept = np.flatnonzero(words)
        self.size, self.doc, self.bare, self.past = words[kept], doc[kept], bare[kept], past[kept]
        self.number = kept - self.at[self.doc]

    def hashes(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The bytes from each line that is not blank to another, without the white space around them, and their hash."""
        raw, hashed = self.bytes, xxhash.xxh3_64_intdigest
        body = [raw[i:j] for i, j in zip(self.bare[low].tolist(), self.past[high].tolist(), strict=True)]
        return np.array([hashed(x) for x in body], np.uint64), body

    @staticmethod
    def _odd(data: np.ndarray, bounds: np.ndarray) -> list[int]:
        """Texts with characters that the cut by bytes does not know."""
        at = np.flatnonzero(_WIDE[data])
        near = np.flatnonzero((data == 0xC2) | (data == 0xE2))
        pad = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two, three = pad[near], pad[near + 1], pad[near + 2]
        space = (one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE2) & ((two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)) | (two == 0x81) & (three == 0x9F))
        return np.unique(np.searchsorted(bounds, np.concatenate([at, near[space]]), "right") - 1).tolist()

    @staticmethod
    def _cut(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """What `lines` and `n_words` give for texts whose white space and stops are ASCII: begin, end, both without white
        space, words and text of each line."""
        n = len(data)
        first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        first[bounds[:-1]] = last[bounds[1:] - 1] = True
        first, last = first[:n], last[:n]
        white, feed = _WHITE[data], data == 10
        begins = white & (first | np.append(True, ~white[:-1])[:n])
        after = np.flatnonzero(begins)
        stopped = ~first[after] & _STOP[data[after - 1]]  # white space after a sentence's stop
        run = np.cumsum(begins, dtype=np.int32) - 1
        ends = np.flatnonzero(feed & (last | np.append(~feed[1:], True)[:n]))
        ends = ends[~stopped[run[ends]]]
        closes = np.flatnonzero(white & (last | np.append(~white[1:], True)[:n]))
        marks = np.zeros(n + 1, bool)
        for cuts in (ends + 1, closes[stopped[run[closes]]] + 1, bounds):
            marks[cuts] = True
        cuts = np.flatnonzero(marks)
        low, high = cuts[:-1], cuts[1:]
        dark = np.flatnonzero(~white)
        i, j = np.searchsorted(dark, low), np.searchsorted(dark, high)
        blank = i == j
        bare, past = low.copy(), low.copy()
        bare[~blank], past[~blank] = dark[i[~blank]], dark[j[~blank] - 1] + 1
        word = np.flatnonzero(~white & (first | np.append(True, white[:-1])[:n]))
        return low, high, bare, past, np.searchsorted(word, high) - np.searchsorted(word, low), np.searchsorted(bounds, low, "right") - 1

    def _cut_text(self, d: int, low: int, high: int) -> np.ndarray:
        """The same of one text, by its characters."""
        own = lines(self.bytes[low:high].decode())
        size = np.array([len(x.encode()) for x in own], np.int64)
        begin = low + np.cumsum(size) - size
        words = np.array(n_words(own), np.int64)
        bare = begin + [len(x[: len(x) - len(x.lstrip())].encode()) for x in own]
        past = bare + [len(x.strip().encode()) for x in own]
        return np.stack([begin, begin + size, bare, past, words, np.full(len(own), d)])

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First line, past the last, and hash of each chunk; lines count over all texts, blank ones left out."""
        n = len(self.size)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = powers(n + 1)
        first = np.searchsorted(self.doc, self.doc)
        at = np.arange(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes(at, at)[0] * up[:n])])
        low = np.maximum(first, at + 1 - WINDOW)
        family = mix((sums[1:] - sums[low]) * down[low]) >> U(63)
        upto = np.concatenate([[0], np.cumsum(self.size)])
        long = self.size >= LONG
        begins = (at == first) | long
        begins[1:] |= long[:-1]
        stretch = np.cumsum(begins)  # short lines between long ones, or one long line
        ends = np.append(begins[1:], True)
        starts, past = [at[long]], [at[long] + 1]
        for f in (0, 1):
            inside = family == U(f)
            begin = np.flatnonzero((begins | np.append(False, (inside & ~ends)[:-1])) & ~long)
            end = np.flatnonzero((ends | inside) & ~long) + 1
            to = np.searchsorted(upto[end], upto[begin] + MIN_WORDS)
            begin, to = begin[to < len(end)], to[to < len(end)]
            same = stretch[begin] == stretch[end[to] - 1]
            starts.append(begin[same])
            past.append(end[to[same]])
        a, b = _pairs(np.concatenate(starts), np.concatenate(past))
        return a, b, mix(mix((sums[b] - sums[a]) * down[a]) ^ (b - a).astype(np.uint64))

    def marked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which lines lie in such chunks or within REACH words of them in the same text."""
        upto = np.concatenate([[0], np.cumsum(self.size)])
        low = np.maximum(np.searchsorted(upto, upto[a] - REACH), np.searchsorted(self.doc, self.doc[a]))
        high = np.minimum(np.searchsorted(upto, upto[b] + REACH, "right") - 1, np.searchsorted(self.doc, self.doc[a], "right"))
        n = len(self.size)
        return np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1))[:n] > 0

    def runs(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First line and past the last of the shortest runs with MIN_WORDS words that begin, or end, with a marked line and
        leave neither the marked lines nor the text."""
        at = np.flatnonzero(marked)
        if not len(at):
            return at, at
        first = np.append(True, (np.diff(at) > 1) | (np.diff(self.doc[at]) > 0))
        low = at[np.flatnonzero(first)][np.cumsum(first) - 1]
        last = np.append(first[1:], True)
        high = at[np.flatnonzero(last)][np.cumsum(first) - 1] + 1
        upto = np.concatenate([[0], np.cumsum(self.size)])
        to = np.searchsorted(upto, upto[at] + MIN_WORDS)
        back = np.searchsorted(upto, upto[at + 1] - MIN_WORDS, "right") - 1
        ahead, behind = to <= high, back >= low
        return _pairs(np.concatenate([at[ahead], back[behind]]), np.concatenate([to[ahead], at[behind] + 1]))


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, in order."""
    both = np.sort((a << 32) | b)
    both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
    return both >> 32, both & 0xFFFFFFFF


def _keyed(docs: DataFrame) -> DataFrame:
    """What tells one row from another (equal rows aside), and the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))


class Runs:
    """Occurrences of runs: the hash of each, its row, its lines and its bytes."""

    FIELDS = (("hash", np.uint64), ("known", np.uint8), ("doc_id", np.int64), ("key", np.int64), ("place", np.int32), ("past", np.int32), ("gone", np.uint8))

    def __init__(self, columns: dict[str, np.ndarray], texts: list[bytes]) -> None:
        self.columns, self.texts = columns, texts

    @classmethod
    def of(cls, own: Lines, marked: np.ndarray, known: np.ndarray, doc_id: np.ndarray, key: np.ndarray) -> Runs:
        """The runs among the marked lines of texts, but for those that overlap their first occurrence in the same text."""
        low, high = own.runs(marked)
        hashes, texts = own.hashes(low, high - 1)
        doc = own.doc[low]
        by = np.lexsort((low, hashes, doc))
        new = np.append(True, (np.diff(doc[by]) > 0) | (hashes[by][1:] != hashes[by][:-1]))[: len(by)]
        first = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        kept = by[new | (low[by] >= high[first])]
        doc, low, high = doc[kept], low[kept], high[kept]
        columns = (hashes[kept], known[doc], doc_id[doc], key[doc], own.number[low], own.number[high - 1] + 1, np.zeros(len(kept)))
        return cls({n: c.astype(t) for (n, t), c in zip(cls.FIELDS, columns, strict=True)}, [texts[i] for i in kept.tolist()])

    @classmethod
    def joined(cls, parts: list[Runs]) -> Runs:
        return cls({n: np.concatenate([p.columns[n] for p in parts]) for n, _ in cls.FIELDS}, [t for p in parts for t in p.texts])

    def judge(self) -> None:
        """Marks as gone what equals its hash's first occurrence byte by byte; what was gone before stays so."""
        c, texts = self.columns, self.texts
        by = np.lexsort((c["place"], c["key"], c["doc_id"], c["known"], c["hash"]))
        by = by[c["gone"][by] == 0]
        h = c["hash"][by]
        new = np.append(True, h[1:] != h[:-1])[: len(h)]
        first = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.flatnonzero(np.logical_or.reduce([c[n][by] != c[n][first] for n in ("known", "doc_id", "key", "place")]))
        same = [texts[i] == texts[j] for i, j in zip(by[later].tolist(), first[later].tolist(), strict=True)]
        c["gone"][by[later[np.array(same, bool)]]] = 1

    def blobs(self, buckets: int) -> pa.RecordBatch:
        """One row for each bucket, in order of hash; what is gone goes without its text."""
        c = self.columns
        bucket = c["hash"] % U(buckets)
        by = np.lexsort((c["hash"], bucket))
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))
        out: dict[str, list] = {n: [] for n in ("bucket", "runs", "sizes", "texts")}
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            own = by[cuts[k] : cuts[k + 1]]
            texts = [b"" if gone else self.texts[i] for i, gone in zip(own.tolist(), c["gone"][own].tolist(), strict=True)]
            out["bucket"].append(k)
            out["runs"].append(b"".join(c[n][own].tobytes() for n, _ in self.FIELDS))
            out["sizes"].append(np.array([len(t) for t in texts], np.int32).tobytes())
            out["texts"].append(pa.compress(b"".join(texts), codec="zstd", asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[n], pa.binary()) for n in ("runs", "sizes", "texts"))], list(out))

    @classmethod
    def read(cls, blobs: pa.Table) -> Runs:
        columns: dict[str, list] = {n: [] for n, _ in cls.FIELDS}
        texts: list[bytes] = []
        for runs_, sizes, body in zip(*(blobs.column(n).to_pylist() for n in ("runs", "sizes", "texts")), strict=True):
            n, low = len(sizes) // 4, 0
            for name, t in cls.FIELDS:
                columns[name].append(np.frombuffer(runs_, t, n, low))
                low += n * np.dtype(t).itemsize
            ends = np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64)
            whole = pa.decompress(body, int(ends[-1]), codec="zstd", asbytes=True)
            texts += [whole[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return cls({n: np.concatenate(x) for n, x in columns.items()}, texts)


def chunk_hashes(docs: DataFrame) -> DataFrame:
    """The hash of every chunk."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array(Lines(part.column(0)).chunks()[2].astype(np.int64))], ["key"])
        common.give_back()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(cut, "key long")


def marked_runs(docs: DataFrame, wanted, buckets: int) -> DataFrame:
    """Blobs by bucket of the runs near chunks in the bitmap."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        held: list[Runs] = []
        size = 0

        def flush() -> pa.RecordBatch:
            own = Runs.joined(held)
            own.judge()
            return own.blobs(buckets)

        for part in parts:
            own = Lines(part.column(2))
            a, b, h = own.chunks()
            spot = spots(h.astype(np.int64))
            inside = ((bits[spot >> U(3)] >> (spot & U(7)).astype(np.uint8)) & 1).astype(bool)
            if inside.any():
                known = part.column(0).is_valid().to_numpy(False)
                held.append(Runs.of(own, own.marked(a[inside], b[inside]), known, part.column(0).fill_null(0).to_numpy(), part.column(1).to_numpy()))
                size += sum(map(len, held[-1].texts)) + 100 * len(held[-1].texts)
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
            held = []
        common.give_back()

    return _keyed(docs).mapInArrow(cut, "bucket int, runs binary, sizes binary, texts binary")


def compared(blobs: DataFrame) -> DataFrame:
    """(doc_id, key, span) of every run that equals an earlier one, byte by byte; a span is its first line and past the last."""

    def meet(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        own = Runs.read(rows)
        own.judge()
        c = own.columns
        gone = c["gone"] == 1
        span = (c["place"][gone].astype(np.int64) << 32) | c["past"][gone]
        return pa.table({"doc_id": pa.array(c["doc_id"][gone], mask=c["known"][gone] == 0), "key": pa.array(c["key"][gone]), "span": pa.array(span)})

    return blobs.groupBy("bucket").applyInArrow(meet, "doc_id long, key long, span long")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, key, span) of every run to remove."""
    spark = docs.sparkSession
    twice = common.stored(chunk_hashes(docs).groupBy("key").count().where("count > 1").select("key"), "line-twice")
    wanted = spark.sparkContext.broadcast(bitmap(twice).tobytes())
    return compared(marked_runs(docs, wanted, BUCKETS * common.n_parts(spark)))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with text rewritten, and n_lines and removed_lines."""
    common.prepare(docs.sparkSession)
    docs = common.without(docs, "n_lines", "removed_lines")
    gone = repeats(docs).groupBy("doc_id", "key").agg(F.collect_set("span").alias("gone"))
    gone = common.stored(gone, "line-repeats").toDF("g0", "g1", "gone")
    columns = docs.columns
    at = columns.index("text")
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)), *(k.alias(f"k{i}") for i, k in enumerate((F.col("doc_id").cast("long"), F.xxhash64("text")))))
    keyed = keyed.join(gone, keyed.k0.eqNullSafe(gone.g0) & (keyed.k1 == gone.g1), "left").drop("k0", "k1", "g0", "g1")

    def rewrite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = Lines(part.column(at))
            found = part.column(len(columns))
            spans = found.flatten().to_numpy()
            doc = np.repeat(np.arange(part.num_rows), found.value_lengths().fill_null(0).to_numpy())
            n = len(own.low)
            edge = np.bincount(own.at[doc] + (spans >> 32), minlength=n + 1) - np.bincount(own.at[doc] + (spans & 0xFFFFFFFF), minlength=n + 1)
            gone = np.cumsum(edge)[:n] > 0
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[own.at])
            texts, raw, kept = part.column(at).to_pylist(), own.bytes, ~gone
            for d in np.flatnonzero(removed).tolist():
                low, high = own.at[d], own.at[d + 1]
                whole = zip(own.low[low:high].tolist(), own.high[low:high].tolist(), strict=True)
                texts[d] = b"".join([raw[i:j] for i, j in compress(whole, kept[low:high].tolist())]).decode()
            out = part.columns[: len(columns)]
            out[at] = pa.array(texts, out[at].type)
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.diff(own.at)), pa.array(removed)], [*columns, "n_lines", "removed_lines"])
        common.give_back()

    return keyed.mapInArrow(rewrite, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_lines long", "removed_lines long"]))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
