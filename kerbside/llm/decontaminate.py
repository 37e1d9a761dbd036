"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to k = floor(m * BUDGET) edits. Cut into k + 1 pieces, an
occurrence within the budget holds one piece at least unchanged; an Aho-Corasick automaton finds every exact piece hit in
one pass over the text, and Myers' bit-parallel distance verifies the stretch of text around each hit. Items and texts are
compared in lower case with white space runs as one space.

Scale: documents are scanned where they lie, without a shuffle; the items are a query set, sent in blocks of at most
BLOCK_CHARS characters (a bound on what is broadcast), one scan for each block.

Defined cases: a null or empty text holds nothing; a null or empty item is not searched; an item of fewer than SHORT
characters has no edit to spend and counts only where it stands as whole words (inside a word it would be found by chance),
in scripts that set words apart: at an end where the item or the text has a letter of a script without spaces between words
(UNSPACED) it counts anywhere; equal items are all reported; repeated rows are reported alike; other columns are ignored; an empty
table gives no rows. Of several occurrences in a document the nearest, then the first, is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edits for each character of an item.
BUDGET = 0.05
#: Characters below which an item must stand as whole words.
SHORT = 20
#: Thai, Lao, Myanmar and Khmer letters, kana, and Chinese characters.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
BLOCK_CHARS = 4 << 20

FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("end", pa.int64())])
FOUND_DDL = "doc_id long, item_id long, distance long, end long"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces of near equal length, with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def whole_words(text: str, low: int, high: int) -> bool:
    """Whether text[low:high] begins and ends where a word may."""
    inside = lambda edge, beyond: beyond.isalnum() and not UNSPACED.match(beyond) and not UNSPACED.match(edge)
    return not (low > 0 and inside(text[low], text[low - 1]) or inside(text[high - 1], text[high : high + 1]))


class Item:
    """An item's bit masks for Myers' algorithm."""

    def __init__(self, item_id: int, text: str) -> None:
        self.id, self.text, self.k = item_id, text, int(len(text) * BUDGET)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def nearest(self, text: str) -> tuple[int, int]:
        """The least edit distance between the item and any stretch of text, and where the first such ends."""
        m = len(self.text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = full, 0, m
        best, end = m, 0
        masks = self.masks
        for j, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            x = eq | minus
            d = ((((eq & plus) + plus) ^ plus) | eq) & full
            hp = minus | (full & ~(d | plus))
            hn = plus & d
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
            hp = hp << 1 & full
            plus = (hn << 1 & full) | (full & ~(x | hp))
            minus = hp & x
            if score < best:
                best, end = score, j
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]]) -> None:
        import ahocorasick

        self.items = [Item(i, t) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for at, piece in pieces(item.text, item.k):
                places.setdefault(piece, []).append((n, at))
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def search(self, raw: str) -> Iterator[tuple[int, int, int]]:
        """(item id, distance, end in the normal form) of every item that occurs within its budget."""
        text = normal(raw)
        spans: dict[int, list[int]] = {}
        if self.items:
            for last, (size, found) in self.automaton.iter(text):
                for n, at in found:
                    if len(self.items[n].text) >= SHORT or whole_words(text, last + 1 - size, last + 1):
                        spans.setdefault(n, []).append(last + 1 - size - at)
        for n, starts in spans.items():
            item = self.items[n]
            best, end = item.k + 1, 0
            low = high = None
            for start in [*sorted(starts), None]:  # hits whose windows overlap are verified together
                if start is not None and low is not None and start - item.k <= high:
                    high = max(high, start + len(item.text) + item.k)
                    continue
                if low is not None:
                    d, e = item.nearest(text[low:high])
                    if d < best:
                        best, end = d, low + e
                if start is not None:
                    low, high = max(0, start - item.k), start + len(item.text) + item.k
            if best <= item.k:
                yield item.id, best, end


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS characters."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-total * 2 // BLOCK_CHARS) or 1
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        block = sorted(((r[0], normal(r[1])) for r in rows), key=lambda r: (r[1], r[0] is None, r[0]))
        yield [r for r in block if r[1]]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, end) of every item found in a document."""
    spark = common.prepare(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for block in _blocks(benchmark):
        items = spark.sparkContext.broadcast(block)

        def search(parts: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items.value)
            found = ((i, *hit) for part in parts for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if text for hit in matcher.search(text))
            yield from common.batches(FOUND, found)

        more = chosen.mapInArrow(search, FOUND_DDL)
        out = more if out is None else out.union(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which no item is found; rows with a null doc_id are judged too."""
    spark = common.prepare(docs.sparkSession)
    for block in _blocks(benchmark):
        items = spark.sparkContext.broadcast(block)
        at = docs.columns.index("text")

        def keep(parts: Iterator[pa.RecordBatch], items=items, at=at) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items.value)
            for part in parts:
                yield part.filter(pa.array([not text or next(matcher.search(text), None) is None for text in part.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
