"""Exact top-k by inner product with a vector-approximation file.

Components become integers floor(256 x). The approximation file stores, for each distinct vector, one byte a dimension: the
number of its cell. Cells lie between quantiles of a bounded sample (SAMPLE vectors by hash) and end at the least and the
largest component of all vectors, so any vector lies in its cells, whatever the sample. A scan of the file gives a lower and
an upper bound of each score: two matrix products of the query's positive and negative parts with the cells' ends. What is
below the k-th lower bound is left out; the rest is visited in order of its bound, the exact vectors being read in rounds of
doubling size, until for each query the k-th exact score exceeds the next bound. Nothing is approximate in the result.

Equal vectors are one entry with their k+1 smallest ids: more of them can't be among a query's k best, and one is its own.
Equal queries are searched once. So copies, however many, cost one entry, and the top lists are joined back to all queries.

Scale: the file is cut into blocks of DATA_BLOCK entries, queries into blocks of QUERY_BLOCK; an equi-join brings each block
of queries to each stripe of STRIPE blocks, and a task holds one of either at a time. The work grows as queries times
entries, as the contract asks; what moves is a byte a dimension for each block of queries. To the driver come the sample, the
least and largest component of each dimension, and counts.

Defined cases: vectors that are null or hold a null, NaN or infinity take no part; shorter vectors count as padded with
zeros (an empty one scores 0); integers are cut off at 32 bits and scores at 64; a row without an id is a candidate after
all others, never a query; rows that repeat an id are queries and candidates of their own, and only the row itself is left
out; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

K, EVERY, SCALE = 5, 50, 256
CELLS, SAMPLE = 256, 16_384
#: Entries and queries of a block; blocks that share a running threshold; queries whose bounds are computed at a time.
DATA_BLOCK, QUERY_BLOCK, STRIPE, ROWS = 8192, 1024, 16, 128
#: Entries of a query that are read in the first round, for each of its k + 1; a round reads twice as many as the one before.
FIRST = 4
_EXACT = 2.0**53


def vectors(table: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows that take part: row (a number of its own), vec_id, v."""
    x = F.col(column).cast("array<double>")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    as_int = F.transform(x, lambda c: F.greatest(F.least(F.floor(c * SCALE), F.lit(2147483647)), F.lit(-2147483648)).cast("int"))
    return table.where(whole).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), as_int.alias("v"))


def entries(rows: DataFrame, k: int = K) -> DataFrame:
    """Distinct vectors: entry (its number), v, members (the k+1 first rows by id)."""
    first = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    some = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    members = F.array_sort(F.collect_list(F.struct("n", "vec_id", "row")))
    return some.groupBy("v").agg(members.alias("members")).select(F.col("members")[0]["row"].alias("entry"), "v", "members")


class Cells:
    """Each dimension's cells: marks between them, and the least and largest component in each."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, largest: np.ndarray, cells: int = CELLS) -> None:
        self.dims = len(least)
        self.marks, self.low, self.high = [], np.zeros((self.dims, cells)), np.zeros((self.dims, cells))
        for d in range(self.dims):
            marks = np.unique(np.quantile(sample[:, d], np.arange(1, cells) / cells, method="nearest"))
            marks = marks[(marks > least[d]) & (marks <= largest[d])]
            ends = np.concatenate([[least[d]], marks, [largest[d] + 1]])
            n = len(marks) + 1
            self.marks.append(marks)
            self.low[d, :n], self.high[d, :n] = ends[:-1], ends[1:] - 1

    def codes(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(m, v[:, d], side="right") for d, m in enumerate(self.marks)], axis=1).astype(np.uint8) if self.dims else np.zeros((len(v), 0), np.uint8)

    def ends(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest components of entries, dimensions first."""
        d = np.arange(self.dims)[:, None]
        return self.low[d, codes.T], self.high[d, codes.T]


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Integer lists as rows, padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims)[None, :] < counts[:, None]] = lists.flatten().to_numpy()
    return out


def fit(found: DataFrame) -> tuple[Cells, int] | None:
    """The cells of entries and how many entries there are; None if there are none."""
    n, dims, shortest = found.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v"))).first()
    if not n:
        return None
    ends = found.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).collect()
    least, largest = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
    for d, low, high, present in ends:
        least[d], largest[d] = (low, high) if present == n else (min(low, 0), max(high, 0))
    sample = found.select("v", F.xxhash64("entry").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow()
    return Cells(matrix(sample.column("v"), dims), least, largest), n


def _packed(df: DataFrame, key: str, blocks: int, dims: int, name: str, derive) -> DataFrame:
    """Blocks of rows: their keys and what derive makes of their vectors, as bytes."""

    def pack(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        return pa.table({"block": pa.array([block], pa.int32()), "keys": pa.array([t.column(key).to_numpy().astype(np.int64).tobytes()], pa.binary()), "body": pa.array([derive(matrix(t.column("v"), dims)).tobytes()], pa.binary())})

    dealt = df.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), key, "v")
    return common.stored(dealt.groupBy("block").applyInArrow(pack, "block int, keys binary, body binary"), name)


class _Search:
    """The running threshold and the candidates of one block of queries over one stripe of entries."""

    def __init__(self, keys: np.ndarray, q: np.ndarray, k: int) -> None:
        self.keys, self.most, self.least = keys, np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
        self.size = float(np.abs(q).max(initial=0)) * q.shape[1]
        self.best = np.full((len(q), k + 1), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def scan(self, entry: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        size = self.size * float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)))
        slack = 0.0 if size < _EXACT else size * 2.0**-44  # sums of doubles beyond 53 bits are rounded
        for at in range(0, len(self.keys), ROWS):
            some = slice(at, at + ROWS)
            upper = self.most[some] @ high + self.least[some] @ low + slack
            lower = self.most[some] @ low + self.least[some] @ high - slack
            both = np.concatenate([self.best[some], lower], axis=1)
            k = self.best.shape[1]
            self.best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            q, e = np.nonzero(upper >= self.best[some].min(axis=1)[:, None])
            self.found.append((q + at, entry[e], upper[q, e], lower[q, e]))

    def rows(self) -> tuple[np.ndarray, ...]:
        q, entry, upper, lower = (np.concatenate(x) for x in zip(*self.found, strict=True))
        kept = upper >= self.best.min(axis=1)[q]
        return self.keys[q[kept]], entry[kept], upper[kept], lower[kept]


def candidates(file: DataFrame, queries: DataFrame, cells: Cells, blocks: int, query_blocks: int, k: int) -> DataFrame:
    """The scan: q, entry, upper and lower bound of every pair that may count, by the thresholds of each stripe."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, search = None, None
        for part in parts:
            for stripe, block, keys, body, q_keys, q_body in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (stripe, block) != key:
                    if search is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in search.rows()], ["q", "entry", "upper", "lower"])
                    own = np.frombuffer(q_keys, np.int64)
                    key, search = (stripe, block), _Search(own, np.frombuffer(q_body, np.int32).reshape(len(own), cells.dims), k)
                entry = np.frombuffer(keys, np.int64)
                search.scan(entry, *cells.ends(np.frombuffer(body, np.uint8).reshape(len(entry), cells.dims)))
        if search is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in search.rows()], ["q", "entry", "upper", "lower"])

    stripes = -(-blocks // STRIPE)
    left = file.select((F.col("block") / STRIPE).cast("int").alias("stripe"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q_block"), "keys", "body")
    right = queries.select(F.col("block").alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.col("keys").alias("q_keys"), F.col("body").alias("q_body"))
    pairs = left.join(right, ["stripe", "q_block"]).select("stripe", "q_block", "keys", "body", "q_keys", "q_body")
    return common.stored(pairs.mapInArrow(run, "q long, entry long, upper double, lower double"), "va-candidates")


def _scores(pairs: DataFrame, dims: int) -> DataFrame:
    """pairs(q, entry, v, qv) with the exact score."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            v, q = matrix(part.column(2), dims), matrix(part.column(3), dims)
            if float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * dims < 2.0**62:
                score = (v * q).sum(axis=1)
            else:
                sums = (v.astype(object) * q.astype(object)).sum(axis=1)
                score = np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in sums], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.int64())], ["q", "entry", "score"])

    return pairs.select("q", "entry", "v", "qv").mapInArrow(run, "q long, entry long, score long")


def _least_of_best(df: DataFrame, column: str, n: int) -> DataFrame:
    """For each q, the n-th largest value of the column (none where there are fewer)."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col(column).desc()))
    return df.select("q", column).withColumn("place", place).where(F.col("place") <= n).groupBy("q").agg(F.min(column).alias("bar"), F.count("*").alias("n")).where(F.col("n") == n).select("q", "bar")


def visit(found: DataFrame, all_: DataFrame, queries: DataFrame, dims: int, k: int) -> DataFrame:
    """Exact scores in order of the upper bound, until the (k+1)-th best of each query exceeds the next bound."""
    bars = _least_of_best(found, "lower", k + 1)
    open_ = found.join(bars, "q", "left").where("bar IS NULL OR upper >= bar")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("upper").desc(), "entry"))
    order = common.stored(open_.select("q", "entry", "upper", place.alias("place")), "va-order")
    exact, low, high, active = None, 0, FIRST * (k + 1), None
    while True:
        batch = order.where((F.col("place") > low) & (F.col("place") <= high))
        batch = batch if active is None else batch.join(active, "q", "left_semi")
        read = batch.join(all_.select("entry", "v"), "entry").join(queries.select("q", F.col("v").alias("qv")), "q")
        scored = common.stored(_scores(read, dims), "va-exact")
        exact = scored if exact is None else exact.union(scored)
        next_ = order.where(F.col("place") == high + 1)
        next_ = next_ if active is None else next_.join(active, "q", "left_semi")
        unsure = next_.join(_least_of_best(exact, "score", k + 1), "q", "left").where("bar IS NULL OR upper >= bar")
        active = common.stored(unsure.select("q"), "va-active")
        if active.isEmpty():
            return exact
        low, high = high, 2 * high


def top_k(table: DataFrame, k: int = K, every: int = EVERY, column: str = "embedding", data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """table(vec_id, vector) -> query_id, rank, vec_id, score: the k best of each row whose id is divisible by `every`."""
    rows = common.stored(vectors(table, column), "va-rows")
    all_ = common.stored(entries(rows, k), "va-entries")
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = common.stored(asked.groupBy("v").agg(F.min("row").alias("q")), "va-queries")
    fitted, n_queries = fit(all_), queries.count()
    if fitted is None or not n_queries:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells, n = fitted
    blocks, query_blocks = -(-n // data_block), -(-n_queries // query_block)
    file = _packed(all_, "entry", blocks, cells.dims, "va-file", cells.codes)
    packed = _packed(queries, "q", query_blocks, cells.dims, "va-asked", lambda v: v.astype(np.int32))
    exact = visit(candidates(file, packed, cells, blocks, query_blocks, k), all_, queries, cells.dims, k)
    best = exact.withColumn("place", F.rank().over(Window.partitionBy("q").orderBy(F.col("score").desc()))).where(F.col("place") <= k + 1)
    members = best.join(all_.select("entry", "members"), "entry").select("q", "score", F.explode("members").alias("m"))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("m.vec_id").asc_nulls_last(), F.col("m.row"))
    ranked = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = ranked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", F.col("m.vec_id").alias("vec_id"), F.col("m.row").alias("row"), "score"))).alias("top"))
    own = asked.join(queries, "v").select("q", "row", F.col("vec_id").alias("query_id"))
    others = own.join(lists, "q").select("query_id", F.slice(F.filter("top", lambda t: t["row"] != F.col("row")), 1, k).alias("top"))
    return others.select("query_id", F.posexplode("top").alias("at", "t")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))


def op11_exact_topk(spark, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return top_k(common.table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: CAST(greatest(least(floor(256 * CAST(x AS DOUBLE)), 2147483647), -2147483648) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS (
    SELECT q.r AS q, q.vec_id AS query_id, c.vec_id AS vec_id, c.r AS r,
        coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS score
    FROM v q JOIN v c ON c.r <> q.r WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, r) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE place <= 5
"""
