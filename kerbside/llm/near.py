"""N-gram Jaccard join: token-combination prefixes over word shingles, verified exactly.

Two documents link when their sets of distinct 5-word shingles (tokens) have Jaccard similarity 0.8 or more. Tokens are
ordered by class of document frequency, rarest first, then by hash. Linked sets of n tokens share a token among their first
p = n - ceil(0.8 n) + 1. Rare tokens of that prefix are indexed singly. Where a prefix reaches frequent tokens, it is
extended by g, so that linked sets share g + 1 tokens there; frequent tokens are dealt into g groups by hash, and every
pair of tokens within a group is indexed instead: of g + 1 shared tokens two meet in a group. g follows the class of n, and
a set indexes for its class and the next, as linked sets are at most a class apart. Combinations grow as n, not as n squared.
Rare tokens are indexed over p + SHARED - 1, where linked sets share SHARED tokens: a set without frequent tokens there that
shares fewer entries than that with others has no link, and leaves before any set travels.

Equal sets are one class, found by the set's hash. Linked sets differ in size by a quarter at most: the classes that share an
index entry are put in order of size and parted where a size is more than 5/4 of the one before, so no link crosses a part, and
a class alone in its part does not share the entry. The classes that share an entry form a group with the one of them
whose tokens are the most frequent, the likely original. A group of up to BLOCK_ALL tokens is checked in one task, where a
class is compared on until it is in the group's largest component. In a larger one all are first compared with the original;
when that has formed components, those outside the largest meet all of the group in blocks of a bounded number of tokens,
and one link to each component is enough. No group is held whole and pairs are never rows. Checking compares whole sets.

Scale: three scans of the texts and no shuffle of them. Tokens and index entries travel as packed blobs by hash bucket (as
many buckets as shuffle partitions). What is broadcast is bounded: at most KNOWN frequent tokens, whatever the corpus, and
a bitmap of FILTER_BITS bits; if either is too small for a corpus, more entries or sets travel, and results stay the same.

Defined cases: null, empty or white text: an empty set, linked with nothing, its own component; fewer than five words: the
whole sequence is the one token; repeated rows: one class; a null doc_id takes part but never names a component; other
columns are ignored; an empty table gives no rows. Tokens are hashes of 64 bits, and sets travel with all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .words import U, mix, shingle_sets

#: Frequency classes are powers of two; tokens in fewer than LEAST documents are of class 0; HOT and above are combined.
LEAST, HOT = 4, 6
#: Most frequent tokens that are told from class 0: 9 bytes each to broadcast.
KNOWN = 500_000
FILTER_BITS = 1 << 25
#: Tokens that a worker holds before it sends them, sorted by bucket: sorting takes about ten times their eight bytes.
FLUSH = 1_000_000
#: Tokens that linked sets must share in their prefixes.
SHARED = 4
#: Tokens in a block of a group, of either side.
BLOCK_ONE, BLOCK_ALL = 250_000, 2_000_000
LOW32, LOW26 = U(0xFFFFFFFF), U((1 << 26) - 1)


def prefix(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def size_class(n: int) -> int:
    return int(np.log(n) / np.log(1.25))


def groups(c: int) -> int:
    return max(1, int(0.05 * 1.25**c))


def similar(shared, n, m):
    """Jaccard of 0.8 or more, in whole numbers."""
    return 100 * shared >= 80 * (n + m - shared)


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed long."""
    n = U(len(tokens))
    return int(mix(np.array([mix(tokens).sum(dtype=np.uint64) ^ mix(np.array([n]))[0]]))[0].astype(np.int64))


def slots(tokens: np.ndarray, buckets: int, mask: np.uint64 = LOW32) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and slot of each token: the space of slots grows with the buckets."""
    return tokens % U(buckets), (tokens // U(buckets)) & mask


def _planes(slot: np.ndarray) -> bytes:
    """Sorted slots as differences, byte plane by byte plane, which shuffle compression shrinks."""
    return np.diff(slot, prepend=U(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def frequencies(docs: DataFrame, buckets: int) -> DataFrame:
    """(code, df) of every slot with LEAST documents or more; code is bucket and slot. A token counts once a document."""

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            bucket, slot = slots(np.concatenate(held), buckets, LOW26)
            order = np.lexsort((slot, bucket))
            bucket, slot = bucket[order], slot[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), pa.array([_planes(slot[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["bucket", "slots"])

        for part in parts:
            for tokens in shingle_sets(part.column(1)):
                held.append(tokens)
                size += len(tokens)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def count(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        slot, n = np.unique(np.concatenate([_unplanes(x.as_py()).astype(np.uint32) for x in rows.column("slots")]), return_counts=True)
        slot, n = slot[n >= LEAST].astype(np.uint64), n[n >= LEAST]
        return pa.table({"code": ((U(key[0].as_py()) << U(32)) | slot).astype(np.int64), "df": n.astype(np.int64)})

    return _texts(docs).mapInArrow(deal, "bucket int, slots binary").groupBy("bucket").applyInArrow(count, "code long, df long")


def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The KNOWN most frequent slots, ties at the end left out, in order, with their class."""
    left = KNOWN
    least = 1 << 62
    for r in sorted(counts.groupBy(F.least("df", F.lit(4096)).alias("df")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r["df"]
    got = counts.where(F.col("df") >= least).toArrow()
    code, df = (got.column(c).to_numpy().astype(np.int64) for c in ("code", "df"))
    order = np.argsort(code)
    return code[order], np.log2(df[order]).astype(np.int8)


class Order:
    """The global order of tokens."""

    def __init__(self, code: np.ndarray, classes: np.ndarray, buckets: int) -> None:
        self.code, self.classes, self.buckets = code, classes, buckets
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self._spot(code)] = True

    @staticmethod
    def _spot(code: np.ndarray) -> np.ndarray:
        return (code ^ (code >> 29)) & ((1 << 22) - 1)

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        bucket, slot = slots(tokens, self.buckets, LOW26)
        code = ((bucket << U(32)) | slot).astype(np.int64)
        out = np.zeros(len(tokens), np.int8)
        maybe = np.flatnonzero(self.seen[self._spot(code)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.code, code[maybe]), len(self.code) - 1)
            out[maybe] = np.where(self.code[at] == code[maybe], self.classes[at], 0)
        return out


def entries(tokens: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Index entries of one set: its rare prefix tokens, and combinations of frequent ones where the base prefix has any."""
    n = len(tokens)
    p = prefix(n)
    if rank.any():
        by = np.argsort(rank, kind="stable")
        tokens, rank = tokens[by], rank[by]
    out = [tokens[: p + SHARED - 1][rank[: p + SHARED - 1] < HOT]]
    if rank[p - 1] >= HOT:
        for c in (size_class(n), size_class(n) + 1):
            g = groups(c)
            hot = tokens[: p + g][rank[: p + g] >= HOT]
            hot = hot[np.lexsort((hot, hot % U(g)))]
            group = hot % U(g)
            for step in range(1, len(hot)):  # pairs that lie `step` apart in their group
                same = group[step:] == group[:-step]
                if not same.any():
                    break
                out.append(mix(mix(hot[:-step][same] ^ U(c + 1)) ^ hot[step:][same]))
    return np.concatenate(out)


def index(docs: DataFrame, order, buckets: int) -> DataFrame:
    """Blobs by bucket of (slot of the entry, class key, set size, mark), a class once a task at least. The mark is the mean
    rank of the set's tokens, plus 128 if no frequent token lies in its longest prefix."""

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Order(*order.value, buckets).ranks
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            counts = [len(h[0]) for h in held]
            bucket, slot = slots(np.concatenate([h[0] for h in held]), buckets)
            key, n, mean = (np.repeat(np.array([h[i] for h in held], t), counts) for i, t in ((1, np.int64), (2, np.uint32), (3, np.uint8)))
            by = np.lexsort((slot, bucket))
            bucket, slot, key, n, mean = bucket[by], slot[by], key[by], n[by], mean[by]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            cuts = list(zip(cuts[:-1], cuts[1:], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), pa.array([_planes(slot[a:b]) for a, b in cuts], pa.binary()), pa.array([key[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([n[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([mean[a:b].tobytes() for a, b in cuts], pa.binary())], ["bucket", "slots", "keys", "sizes", "marks"])

        for part in parts:
            for tokens in shingle_sets(part.column(1)):
                if len(tokens) and (key := set_key(tokens)) not in seen:
                    seen.add(key)
                    rank = ranks(tokens)
                    held.append((entries(tokens, rank), key, len(tokens), min(127, int(8 * rank.mean())) + 128 * bool(np.sort(rank)[: prefix(len(tokens)) + SHARED - 1][-1] < HOT)))
                    size += len(held[-1][0])
                    if size >= FLUSH // 2:
                        yield flush()
                        held, size = [], 0
            if len(seen) > 1_000_000:  # a class may then be indexed once more
                seen.clear()
        if held:
            yield flush()

    return _texts(docs).mapInArrow(deal, "bucket int, slots binary, keys binary, sizes binary, marks binary")


FOUND = "entry long, key long, n long, mean int, plain boolean"


def shared_entries(blobs: DataFrame) -> DataFrame:
    """Rows (entry, key, n, mean, plain) of every entry that two classes or more of like size share."""

    def meet(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        cols = {c: rows.column(c).to_pylist() for c in ("slots", "keys", "sizes", "marks")}
        slot = np.concatenate([_unplanes(x) for x in cols["slots"]])
        keys, n, mark = (np.concatenate([np.frombuffer(x, t) for x in cols[c]]) for c, t in (("keys", np.int64), ("sizes", np.uint32), ("marks", np.uint8)))

        def twins(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(x), bool)
            out[1:] = x[1:] == x[:-1]
            out[:-1] |= x[1:] == x[:-1]
            return out

        by = np.argsort(slot, kind="stable")  # most entries have one class: they leave before the costly sort
        by = by[twins(slot[by])]
        by = by[np.lexsort((keys[by], n[by], slot[by]))]
        by = by[np.append(True, (slot[by][1:] != slot[by][:-1]) | (keys[by][1:] != keys[by][:-1]))[: len(by)]]
        size = n[by].astype(np.int64)
        begins = np.append(True, (slot[by][1:] != slot[by][:-1]) | (4 * size[1:] > 5 * size[:-1]))[: len(by)]
        part = np.cumsum(begins)
        first = size[begins][part - 1].astype(np.uint64)  # tells the parts of an entry apart
        kept = twins(part)
        by, first = by[kept], first[kept]
        entry = mix(((U(key[0].as_py()) << U(32)) | slot[by]) ^ mix(first)).astype(np.int64)
        return pa.table({"entry": entry, "key": keys[by], "n": n[by].astype(np.int64), "mean": (mark[by] & 127).astype(np.int32), "plain": mark[by] >= 128})

    return blobs.groupBy("bucket").applyInArrow(meet, FOUND)


def candidate_groups(found: DataFrame) -> DataFrame:
    """(grp, key, n): the classes that share an entry, by the entry's class of the highest mean rank."""
    for _ in range(2):  # a class that leaves may take others' entries with it
        found = found.drop("grp")
        few = found.groupBy("key").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("plain").alias("plain"))
        few = few.where(F.col("plain") & (F.col("c") < F.least(F.lit(SHARED), F.ceil(F.col("n") * 4 / 5))))
        left = found.join(few.select("key"), "key", "left_anti")
        lead = left.groupBy("entry").agg(F.count("*").alias("c"), F.min(F.struct(-F.col("mean"), "key")).getField("key").alias("grp")).where("c > 1").select("entry", "grp")
        left = common.stored(left.join(lead, "entry"), "near-shared")
        common.discard(found)
        found = left
    groups_ = common.stored(found.select("grp", "key", "n").distinct(), "near-groups")
    common.discard(found)
    return groups_


def bitmap(keys: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set at each key's hash: at most FILTER_BITS / 8 bytes, whatever the number of keys."""
    spot = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)) + 1  # buckets and positions count from 1
    rows = keys.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


DOCS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])
DOCS_DDL = "row long, doc_id long, text_key long, key long, n long, tokens binary"


def spots(keys: list[int] | np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of each key, modulo FILTER_BITS."""
    m = [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]
    p1, p2, p3, p4, p5 = map(U, m)
    turn = lambda x, r: (x << U(r)) | (x >> U(64 - r))
    x = np.array(keys, np.int64).astype(np.uint64)
    h = (U(42) + p5 + U(8)) ^ (turn(x * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> U(33))) * p2
    h = (h ^ (h >> U(29))) * p3
    return (h ^ (h >> U(32))) & U(FILTER_BITS - 1)


def classes(docs: DataFrame, wanted) -> DataFrame:
    """Every document's class key and set size, with the set itself for classes in the bitmap, once a task at least."""

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        sent: set[int] = set()
        for part in parts:
            sets = list(shingle_sets(part.column(1)))
            keys = [set_key(s) for s in sets]
            spot = spots(keys)
            inside = (bits[spot >> U(3)] >> (spot & U(7)).astype(np.uint8)) & 1

            def rows() -> Iterator[tuple]:
                for row, i, text_key, key, tokens, maybe in zip(*(part.column(c).to_pylist() for c in (2, 0, 3)), keys, sets, inside.tolist(), strict=True):
                    send = maybe and len(tokens) and key not in sent
                    if send:
                        sent.add(key)
                    yield row, i, text_key, key if len(tokens) else None, len(tokens), tokens.tobytes() if send else None

            yield from common.batches(DOCS, rows(), weigh=lambda r: len(r[5] or b""))
            if len(sent) > 1_000_000:
                sent.clear()

    return _texts(docs).withColumns({"row": F.monotonically_increasing_id(), "text_key": F.xxhash64("text")}).mapInArrow(find, DOCS_DDL)


def _tokens(blob: pa.Scalar) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), np.uint64)


class _Sets:
    """Sets indexed by token, to count what one shares with each."""

    def __init__(self, tokens: list[np.ndarray]) -> None:
        self.n = np.array([len(t) for t in tokens], np.int64)
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        by = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[by], np.repeat(np.arange(len(tokens)), self.n)[by]

    def near(self, tokens: np.ndarray) -> np.ndarray:
        """Which of the sets are similar to tokens."""
        low, high = np.searchsorted(self.flat, tokens, "left"), np.searchsorted(self.flat, tokens, "right")
        hits = [self.owner[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if a < b]
        shared = np.bincount(np.concatenate(hits), minlength=len(self.n)) if hits else np.zeros(len(self.n), np.int64)
        return np.flatnonzero(similar(shared, len(tokens), self.n))


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(found: set[tuple[int, int]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=LINKS)


def whole(members: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is connected in each group of members(grp, key, tokens), in one task each."""

    def meet(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        keys = rows.column("key").to_pylist()
        tokens = [_tokens(t) for t in rows.column("tokens")]
        sets = _Sets(tokens)
        label = np.arange(len(keys))
        found: set[tuple[int, int]] = set()
        at = key[0].as_py()
        order = sorted(range(len(keys)), key=lambda i: keys[i] != at)  # the original first
        for i in order:
            if (label == label[i]).sum() * 2 > len(keys):
                continue  # in the largest component: what it links to is found from the other side
            for j in sets.near(tokens[i]):
                if label[i] != label[j]:
                    found.add((keys[i], keys[j]))
                    label[label == label[j]] = label[i]
        return _links(found)

    return members.groupBy("grp").applyInArrow(meet, "a long, b long")


def star(members: DataFrame) -> DataFrame:
    """Links (a, b) of each group's original with its members(grp, key, tokens, origin)."""

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = [bool(len(_Sets([_tokens(x)]).near(_tokens(y)))) for x, y in zip(part.column(2), part.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return members.where("grp <> key").select(F.col("grp").alias("a"), F.col("key").alias("b"), "origin", "tokens").mapInArrow(check, "a long, b long")


def blocked(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of components (label) of members(key, n, label, grp, tokens) that a link joins: each member outside its group's
    largest component against all others of the group, in blocks."""
    main = members.groupBy("grp", "label").agg(F.count("*").alias("c")).groupBy("grp").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    sized = members.join(main, "grp").withColumn("one", F.col("label") != F.col("main"))
    blocks = sized.groupBy("grp").agg(F.ceil(F.sum(F.when(F.col("one"), F.col("n"))) / BLOCK_ONE).cast("int").alias("ones"), F.ceil(F.sum("n") / BLOCK_ALL).cast("int").alias("alls"))
    sized = sized.join(blocks.where("ones > 0"), "grp")
    by_hash = lambda n: F.pmod(F.hash("key"), F.col(n))
    one = sized.where("one").select("grp", by_hash("ones").alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"), F.lit(True).alias("one"), "label", "tokens")
    every = sized.select("grp", F.explode(F.sequence(F.lit(0), F.col("ones") - 1)).alias("i"), by_hash("alls").alias("j"), F.lit(False).alias("one"), "label", "tokens")

    def meet(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        one = np.array(rows.column("one").to_pylist(), bool)
        labels = rows.column("label").to_numpy()
        tokens = [_tokens(t) for t in rows.column("tokens")]
        all_, ones = np.flatnonzero(~one), np.flatnonzero(one)
        sets = _Sets([tokens[i] for i in all_])
        found: set[tuple[int, int]] = set()
        for i in ones:
            near = labels[all_[sets.near(tokens[i])]]
            found.update((int(labels[i]), int(x)) for x in np.unique(near[near != labels[i]]))
        return _links(found)

    return one.unionByName(every).groupBy("grp", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text)."""
    return near_rows(docs).select("doc_id", "n_shingles", "component_id")


def surplus(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key) of the rows that go if one of each component stays: the one with the smallest doc_id, then text_key
    (the text's xxhash64); a null doc_id comes last. Rows without words are components of their own."""
    found = common.stored(near_rows(docs).where("label IS NOT NULL").select("doc_id", "text_key", "label"), "near-rows")
    one = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("one"))
    stays = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("text_key") == F.col("one.text_key"))
    return found.join(one, "label").where(~stays).select("doc_id", "text_key").distinct()


def near_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, label) for every row of docs(doc_id, text); label tells components apart
    where doc_ids repeat, and is null for an empty set."""
    spark = common.prepare(docs.sparkSession)
    buckets = common.n_parts(spark)
    counts = common.stored(frequencies(docs, buckets), "near-frequent")
    order = spark.sparkContext.broadcast(frequent(counts))
    found = common.stored(shared_entries(index(docs, order, buckets)), "near-found")
    common.discard(counts)
    members = candidate_groups(found)
    wanted = spark.sparkContext.broadcast(bitmap(members.select("key")).tobytes())
    own = common.stored(classes(docs, wanted), "near-classes")

    # A class's set from one of the rows that carry it.
    sent = own.where("tokens IS NOT NULL")
    one = members.join(sent.groupBy("key").agg(F.min("row").alias("row")), "key")
    sized = common.stored(members.groupBy("grp").agg((F.sum("n") > BLOCK_ALL).alias("large")), "near-sized")
    held = one.join(sized, "grp").join(sent.select("key", "row", "tokens"), ["key", "row"]).select("grp", "key", "n", "large", "tokens")
    links = common.stored(whole(held.where("NOT large").select("grp", "key", "tokens")), "near-links")
    any_large = not sized.where("large").isEmpty()
    if any_large:
        large = common.stored(held.where("large").drop("large"), "near-large")
        origin = large.where("grp = key").select("grp", F.col("tokens").alias("origin"))
        links = links.union(common.stored(star(large.join(origin, "grp")), "near-links"))
    common.discard(members, sized)
    label = components(links)
    if any_large:
        labelled = large.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        label = components(links.union(common.stored(blocked(labelled), "near-links")))
        common.discard(large)

    plain = common.stored(own.drop("row", "tokens"), "near-documents")
    common.discard(own, links)
    own = plain
    least = own.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"))
    named = common.stored(least.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key")), "near-named")
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    names = named.select("key", "label").join(names, "label")
    out = own.where("key IS NOT NULL").join(names, "key").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", "label")
    return out.union(own.where("key IS NULL").select("doc_id", "text_key", "n", "doc_id", F.lit(None).cast("long")))


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_components(common.table(spark, sf_dir, "documents"))


#: DuckDB's rows: shingles as strings, every pair that shares one, components by closure.
SQL = r"""WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
  sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words),
  tokens AS (SELECT doc_id, len(s) AS n, UNNEST(s) AS token FROM sets),
  pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 80 * (a.n + b.n - COUNT(*))),
  links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
  reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT r.doc_id, CAST(MIN(len(s)) AS BIGINT) AS n_shingles, MIN(r.other) AS component_id FROM reach r JOIN sets ON sets.doc_id = r.doc_id GROUP BY r.doc_id"""
