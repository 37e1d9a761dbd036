"""LM scoring with a hidden Markov model over word classes.

Words of the training documents are counted exactly. The SINGLES most frequent words and the end of a text are classes of
their own; other words fall into GROUPS classes by hash. An HMM with STATES latent states over classes is trained by
Baum-Welch: each task computes expected start, transition and emission counts of its sequences under the present
parameters, the counts are summed across partitions, and the driver, which sees nothing but these sums, re-estimates. A
text's score is the log10 likelihood of its class sequence by the scaled forward recursion over the whole text, plus the
log10 probability of each word within its class. An unknown word is one event of its class, of weight 0.1.

Scale: counts travel as packed blobs by hash bucket and are never gathered whole. What is broadcast is bounded: the KNOWN
most frequent words and the HMM's parameters. Words outside that table, known or not, meet the counts of their bucket in a
cogroup. Class sequences are written once, two bytes a word; a task's documents are trained and scored in batches of
BATCH words, sequences of like length together, and never cut. Training keeps the forward probabilities of STEPS words at a
time: those of a longer text are computed again, from the ones kept at every STEPS words, as the backward pass reaches them.
Rounds end when the likelihood rises by less than the share SETTLED, after ROUNDS at most.

Defined cases: a null or empty text is the end alone; a null doc_id is in training; repeated rows count as often as they
occur; without training documents every count is 0; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import U, mix, utf8, word_hashes

STATES, ROUNDS, SETTLED = 6, 12, 1e-3
SINGLES, GROUPS = 1024, 256
CLASSES = 1 + SINGLES + GROUPS
KNOWN = 300_000
WEIGHT = 0.1
BATCH, HELD, STEPS, FLUSH = 1_000_000, 16_000_000, 8192, 4_000_000


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _dealt(hashes: np.ndarray, buckets: int, *others: np.ndarray) -> Iterator[tuple]:
    """(bucket, hashes, others...) as bytes for every bucket that has any."""
    bucket = hashes % U(buckets)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))
    columns = [x[by] for x in (hashes, *others)]
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, *(x[cuts[b] : cuts[b + 1]].tobytes() for x in columns)


COUNTS = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])


def vocabulary(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, hashes, counts, types, tokens): the words of docs and how often each occurs, by bucket."""

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, size = [], 0
            for part in parts:
                held.append(word_hashes(*utf8(part.column(0)))[0])
                size += len(held[-1])
                if size >= FLUSH:
                    words, n = np.unique(np.concatenate(held), return_counts=True)
                    yield from _dealt(words, buckets, n.astype(np.int64))
                    held, size = [], 0
            if size:
                words, n = np.unique(np.concatenate(held), return_counts=True)
                yield from _dealt(words, buckets, n.astype(np.int64))

        yield from common.batches(COUNTS, rows(), weigh=lambda r: len(r[1]) * 2)

    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        words = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in rows.column("hashes")])
        n = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in rows.column("counts")])
        words, back = np.unique(words, return_inverse=True)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, back, n)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "hashes": [words.tobytes()], "counts": [total.tobytes()], "types": [len(words)], "tokens": [int(n.sum())]})

    return docs.select("text").mapInArrow(deal, "bucket int, hashes binary, counts binary").groupBy("bucket").applyInArrow(add, "bucket int, hashes binary, counts binary, types long, tokens long")


def _over_buckets(words: DataFrame, derive, names: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """derive(hashes, counts) gives arrays of rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for h, n in zip(part.column("hashes"), part.column("counts"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(derive(np.frombuffer(h.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64)), names, strict=True)], [x for x, _ in names])

    return words.select("hashes", "counts").mapInArrow(run, ddl)


def _level(counts: np.ndarray) -> np.ndarray:
    return (8 * np.log2(counts)).astype(np.int64)


def frequent(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, KNOWN at most: whole levels of counts from the top, in order of hash, with their counts."""

    def tally(_: np.ndarray, counts: np.ndarray):
        return np.unique(_level(counts), return_counts=True)

    levels = _over_buckets(words, tally, [("level", pa.int64()), ("types", pa.int64())], "level long, types long").groupBy("level").agg(F.sum("types").alias("types"))
    left, least = KNOWN, 1 << 62
    for r in sorted(levels.collect(), reverse=True):
        left -= r["types"]
        if left < 0:
            break
        least = r["level"]

    def choose(hashes: np.ndarray, counts: np.ndarray):
        keep = _level(counts) >= least
        return hashes[keep].astype(np.int64), counts[keep]

    got = _over_buckets(words, choose, [("hash", pa.int64()), ("n", pa.int64())], "hash long, n long").toArrow()
    hashes, n = got.column("hash").to_numpy().astype(np.uint64), got.column("n").to_numpy()
    by = np.argsort(hashes)
    return hashes[by], n[by]


@dataclass
class Table:
    """What every task knows of the words: the frequent ones, the classes, and the weight of each class."""

    hashes: np.ndarray
    counts: np.ndarray
    singles: np.ndarray  # hashes, in order
    n_docs: int
    n_words: int
    types: int
    log_mass: np.ndarray | None = None  # log10 of each class's weight

    def classes(self, words: np.ndarray) -> np.ndarray:
        out = (words % U(GROUPS)).astype(np.int16) + np.int16(1 + SINGLES)
        if len(self.singles):
            at = np.minimum(np.searchsorted(self.singles, words), len(self.singles) - 1)
            same = self.singles[at] == words
            out[same] = at[same] + 1
        return out

    def known(self, words: np.ndarray) -> np.ndarray:
        """Each frequent word's count; 0 for others."""
        if not len(self.hashes):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.counts[at], 0)

    @property
    def log_total(self) -> float:
        n_types = self.types + (self.n_docs > 0)
        return float(np.log10(self.n_words + self.n_docs + WEIGHT * (n_types + 1)))


def build_table(train: DataFrame, words: DataFrame) -> tuple[Table, np.ndarray]:
    """The table, and the share of each class among training tokens."""
    n_docs = train.count()
    types, tokens = words.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    hashes, counts = frequent(words)
    top = np.lexsort((hashes, -counts))[:SINGLES]
    table = Table(hashes, counts, np.sort(hashes[top]), n_docs, tokens, types)

    def weigh(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CLASSES)  # one row for each class and task
        for part in parts:
            for h, n in zip(part.column("hashes"), part.column("counts"), strict=True):
                sums += np.bincount(table.classes(np.frombuffer(h.as_py(), np.uint64)), weights=np.frombuffer(n.as_py(), np.int64) + WEIGHT, minlength=CLASSES)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["class", "weight"])

    rows = words.select("hashes", "counts").mapInArrow(weigh, "class long, weight double").groupBy("class").agg(F.sum("weight").alias("weight")).collect()
    mass = np.zeros(CLASSES)
    for r in rows:
        mass[r["class"]] = r["weight"]
    mass[0] = n_docs + WEIGHT
    mass[1 + SINGLES :] += WEIGHT
    table.log_mass = np.log10(np.maximum(mass, WEIGHT))
    return table, np.maximum(mass, WEIGHT) / np.maximum(mass, WEIGHT).sum()


CODED = pa.schema([("part", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("classes", pa.binary()), ("n_known", pa.int64()), ("log_counts", pa.float64()), ("log_within", pa.float64()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("rows", pa.binary())])
CODED_DDL = "part long, row long, doc_id long, held_out boolean, classes binary, n_known long, log_counts double, log_within double, bucket int, hashes binary, rows binary"


def coded(docs: DataFrame, shared, buckets: int) -> DataFrame:
    """Two kinds of rows: a document with its classes and sums over frequent words, and, where bucket is not null, the other
    words of a task's documents, FLUSH words at a time, with the rows that they occur in."""

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Table = shared.value

        def other(part: int, rare: list) -> Iterator[tuple]:
            if rare:
                for b, h, r in _dealt(np.concatenate([x for x, _ in rare]), buckets, np.concatenate([y for _, y in rare])):
                    yield part, None, None, None, None, None, None, None, b, h, r

        def rows() -> Iterator[tuple]:
            rare: list[tuple[np.ndarray, np.ndarray]] = []
            size = at_part = blocks = 0
            for part in parts:
                words, at, _ = word_hashes(*utf8(part.column("text")))
                ids = part.column("row").to_numpy()
                if len(ids):  # a new part after each FLUSH, so that what meets in scoring is bounded
                    at_part = (int(ids[0]) >> 33 << 24) + blocks
                distinct, back = np.unique(words, return_inverse=True)
                n, c = table.known(distinct), table.classes(distinct)
                logs = np.where(n > 0, np.log10(n + WEIGHT), 0.0)
                single = c <= SINGLES
                within = np.where(single, -logs, -table.log_mass[c])
                # Without rare words' own part, which joins later.
                cum = [np.concatenate(([0], np.cumsum(x[back]))) for x in ((n > 0).astype(np.int64), logs, within)]
                classes = c[back]
                owner = np.repeat(ids, np.diff(at))
                odd = (n == 0)[back]
                rare.append((words[odd], owner[odd]))
                size += len(words)
                log_end = float(np.log10(table.n_docs + WEIGHT))
                for i, (doc, out, a, b) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    known, logged, inner = (x[b] - x[a] for x in cum)
                    yield at_part, int(ids[i]), doc, out, np.append(classes[a:b], np.int16(0)).tobytes(), int(known) + (table.n_docs > 0), float(logged) + log_end, float(inner) - log_end, None, None, None
                if size >= FLUSH:
                    yield from other(at_part, rare)
                    rare, size = [], 0
                    blocks += 1
            yield from other(at_part, rare)

        yield from common.batches(CODED, rows(), weigh=lambda r: len(r[4] or b"") + 2 * len(r[9] or b""))

    return docs.mapInArrow(encode, CODED_DDL)


RARE = pa.schema([("part", pa.int64()), ("rows", pa.binary()), ("logs", pa.binary()), ("knowns", pa.binary())])


def rare_sums(others: DataFrame, words: DataFrame) -> DataFrame:
    """(part, rows, logs, knowns): for each task's documents, sums over the words outside the frequent table."""

    def meet(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        hashes = np.frombuffer(right.column("hashes")[0].as_py(), np.uint64) if right.num_rows else np.zeros(0, np.uint64)
        counts = np.frombuffer(right.column("counts")[0].as_py(), np.int64) if right.num_rows else np.zeros(0, np.int64)
        out = []
        for part, h, r in zip(left.column("part").to_pylist(), left.column("hashes"), left.column("rows"), strict=True):
            words_, rows_ = np.frombuffer(h.as_py(), np.uint64), np.frombuffer(r.as_py(), np.int64)
            n = np.zeros(len(words_), np.int64)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, words_), len(hashes) - 1)
                n = np.where(hashes[at] == words_, counts[at], 0)
            ids, back = np.unique(rows_, return_inverse=True)
            out.append((part, ids.tobytes(), np.bincount(back, weights=np.log10(n + WEIGHT)).tobytes(), np.bincount(back, weights=n > 0).astype(np.int64).tobytes()))
        return pa.Table.from_batches([common.record_batch(RARE, out)] if out else [], RARE)

    return others.select("bucket", "part", "hashes", "rows").groupBy("bucket").cogroup(words.select("bucket", "hashes", "counts").groupBy("bucket")).applyInArrow(meet, "part long, rows binary, logs binary, knowns binary")


@dataclass
class Model:
    start: np.ndarray  # STATES
    move: np.ndarray  # STATES x STATES
    emit: np.ndarray  # CLASSES x STATES


def first_model(share: np.ndarray) -> Model:
    """Sticky states whose emissions are the corpus's, disturbed by a fixed hash of class and state."""
    c, k = np.meshgrid(np.arange(CLASSES, dtype=np.uint64), np.arange(STATES, dtype=np.uint64), indexing="ij")
    noise = mix(c * U(STATES) + k + U(12345)).astype(np.float64) / 2.0**64
    emit = share[:, None] * (0.1 + noise)
    move = np.full((STATES, STATES), 0.1 / max(1, STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / max(1, STATES - 1))
    return Model(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _by_length(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of sequences by falling length, all classes in one array, and where each begins and how many steps it has."""
    n = np.array([len(s) for s in seqs])
    by = np.argsort(-n, kind="stable")
    flat = np.concatenate([seqs[i] for i in by])
    n = n[by]
    return by, flat, np.concatenate(([0], np.cumsum(n)[:-1])), n


def likelihoods(seqs: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 likelihood of each sequence, by the scaled forward recursion over its whole length."""
    by, flat, at, n = _by_length(seqs)
    total = np.zeros(len(seqs))
    alpha = None
    active = len(n) - np.searchsorted(n[::-1], np.arange(n[0]), "right")
    for t, k in enumerate(active.tolist()):
        e = model.emit[flat[at[:k] + t]]
        alpha = (model.start if alpha is None else alpha[:k] @ model.move) * e
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[:k] += np.log10(scale)
    out = np.empty(len(seqs))
    out[by] = total
    return out


def expected(seqs: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected start, transition and emission counts and the log10 likelihood of the sequences, each taken whole."""
    _, flat, at, n = _by_length(seqs)
    steps = int(n[0])
    active = (len(n) - np.searchsorted(n[::-1], np.arange(steps), "right")).tolist()
    begin, emit, move = (x.astype(np.float32) for x in (model.start, model.emit, model.move))
    logs = 0.0

    def forward(first: int, past: int, alpha: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Classes, scaled forward probabilities and scales of the steps, and the bounds of each step in them."""
        low = np.concatenate(([0], np.cumsum(active[first:past])))
        obs, alphas, scales = np.empty(low[-1], np.int16), np.empty((low[-1], STATES), np.float32), np.empty(low[-1], np.float32)
        for t in range(first, past):
            i, k = low[t - first], active[t]
            o = obs[i : i + k] = flat[at[:k] + t]
            a = emit[o] * (begin if alpha is None else alpha[:k] @ move)
            s = a.sum(1)
            alpha = alphas[i : i + k] = a / s[:, None]
            scales[i : i + k] = s
        return obs, alphas, scales, low

    kept, blocks = [None], range(0, steps, STEPS)  # what is known before each block of steps
    for first in blocks:
        block = forward(first, min(first + STEPS, steps), kept[-1])
        logs += float(np.log10(block[2], dtype=np.float64).sum())
        kept.append(block[1][block[3][-2] :].copy())
    moves, emits = np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
    beta, later = np.zeros((0, STATES), np.float32), np.zeros((0, STATES), np.float32)  # of the step after; emit * beta / scale
    for first in reversed(blocks):
        past = min(first + STEPS, steps)
        obs, alphas, scales, low = block if past == steps else forward(first, past, kept[first // STEPS])
        for t in range(past - 1, first - 1, -1):
            i, k = low[t - first], active[t]
            here = alphas[i : i + k]
            beta = np.ones((k, STATES), np.float32)
            if len(later):
                moves += (here[: len(later)].T @ later) * model.move
                beta[: len(later)] = later @ move.T
            later = emit[obs[i : i + k]] * beta / scales[i : i + k, None]
            here *= beta  # now the posterior of each state
        for k in range(STATES):
            emits[:, k] += np.bincount(obs, weights=alphas[:, k], minlength=CLASSES)
    return alphas[: active[0]].sum(0, dtype=np.float64), moves, emits, logs


def _grouped(parts: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Class sequences in batches of about BATCH words, those of like length together: a batch takes as many steps as its
    longest. HELD words, two bytes each, are in hand at a time."""
    held: list[np.ndarray] = []
    size = 0

    def dealt() -> Iterator[list[np.ndarray]]:
        some, words = [], 0
        for seq in sorted(held, key=len, reverse=True):
            some.append(seq)
            words += len(seq)
            if words >= BATCH:
                yield some
                some, words = [], 0
        if some:
            yield some

    for part in parts:
        for c in part.column("classes"):
            held.append(np.frombuffer(c.as_py(), np.int16))
            size += len(held[-1])
        if size >= HELD:
            yield from dealt()
            held, size = [], 0
    yield from dealt()


def baum_welch(train: DataFrame, share: np.ndarray, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model after `rounds` rounds at most, and each round's log10 likelihood of the training sequences."""
    spark = train.sparkSession
    model, seen = first_model(share), []
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def count(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = None
            for seqs in _grouped(parts):
                got = expected(seqs, shared.value)
                flat = np.concatenate([np.ravel(x) for x in got])
                sums = flat if sums is None else sums + flat
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["slot", "value"])

        got = train.select("classes").mapInArrow(count, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
        if not got.num_rows:
            return model, seen
        flat = np.zeros(STATES + STATES**2 + CLASSES * STATES + 1)
        flat[got.column("slot").to_numpy()] = got.column("value").to_numpy()
        start, move, emit = (x + y for x, y in zip(np.split(flat[:-1], [STATES, STATES + STATES**2]), (1.0, 1.0, np.repeat(share, STATES)), strict=True))
        move, emit = move.reshape(STATES, STATES), emit.reshape(CLASSES, STATES)
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        seen.append(float(flat[-1]))
        shared.unpersist()
        if len(seen) > 1 and seen[-1] - seen[-2] < SETTLED * abs(seen[-2]):
            break
    return model, seen


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORED_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(own: DataFrame, rare: DataFrame, table: Table, model: Model) -> DataFrame:
    """The result rows: a task's documents meet the sums over their rare words."""
    shared = own.sparkSession.sparkContext.broadcast((table.log_total, table.n_words + table.n_docs, model))

    def score(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        log_total, tokens, model = shared.value
        if not left.num_rows:
            return pa.Table.from_batches([], SCORED)
        row = left.column("row").to_numpy()
        logs, known = left.column("log_counts").to_numpy().copy(), left.column("n_known").to_numpy().copy()
        inner = left.column("log_within").to_numpy()
        by = np.argsort(row)
        for r, v, n in zip(*(right.column(c) for c in ("rows", "logs", "knowns")), strict=True):
            at = by[np.searchsorted(row[by], np.frombuffer(r.as_py(), np.int64))]
            logs[at] += np.frombuffer(v.as_py(), np.float64)
            known[at] += np.frombuffer(n.as_py(), np.int64)
        out = np.empty(len(row))
        seqs, size, first = [], 0, 0
        for i, c in enumerate(left.column("classes")):
            seqs.append(np.frombuffer(c.as_py(), np.int16))
            size += len(seqs[-1])
            if size >= 4 * BATCH or i == len(row) - 1:
                out[first : i + 1] = likelihoods(seqs, model)
                seqs, size, first = [], 0, i + 1
        n = np.array([len(c.as_buffer()) // 2 for c in left.column("classes")])
        return pa.table([left.column("doc_id"), left.column("held_out"), n, known, np.full(len(n), tokens), logs - n * log_total, out + logs + inner], schema=SCORED)

    return own.select("part", "row", "doc_id", "held_out", "classes", "n_known", "log_counts", "log_within").groupBy("part").cogroup(rare.groupBy("part")).applyInArrow(score, SCORED_DDL)


def score_documents(docs: DataFrame) -> DataFrame:
    spark = common.prepare(docs.sparkSession)
    buckets = common.n_parts(spark)
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    train = own.where("NOT held_out").select("text")
    words = common.stored(vocabulary(train, buckets), "lm-words")
    table, share = build_table(train, words)
    code = common.stored(coded(own, spark.sparkContext.broadcast(table), buckets), "lm-coded")
    documents = code.where("bucket IS NULL")
    model, _ = baum_welch(documents.where("NOT held_out"), share)
    rare = rare_sums(code.where("bucket IS NOT NULL"), words)
    return scored(documents, rare, table, model)


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
