"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Merges follow the byte-pair agenda: of all adjacent symbols whose union is a piece, the one with the best score (then the
leftmost) is merged next. With dropout each candidate is judged once, when it enters the agenda, and skipped where a hash
keyed by (seed, doc_id, the chunk's number in the text, the candidate's bounds in the chunk) falls below the rate. So each
occurrence of a chunk is judged anew, in its own place, while runs and retries agree. Nothing that is remembered depends on
dropout: a chunk's symbols, its ids without dropout and the candidates seen on the way.

A space is written as U+2581, and one is put before the text. Characters outside the vocabulary, and a literal U+2581, are
spelled as byte pieces; so decoding gives back every text exactly. No piece has U+2581 after another character, hence
chunks that begin with U+2581 are encoded on their own (the vocabulary is checked for this on loading).

The agendas of many chunks run side by side, a column of a matrix each. An occurrence with none of the plain candidates
skipped has the plain ids; only the others run an agenda of their own. Chunks of more than WIDEST symbols use a heap,
of any length: bounds beyond 21 bits are folded into the hash one after the other.

Scale: a scan without a shuffle, whole texts, every row; the vocabulary is read once a worker. A block of BLOCK occurrences
is held at a time, whatever a text's length.

Defined cases: a null text has no ids and decodes to null; an empty one has no ids; repeated rows are encoded alike; a null
doc_id is keyed as 0; other columns are kept, but an input column `ids` (in decode: `decoded`) gives way to the one that is
added; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .words import U, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE, SEED = 0.1, 20240229
#: Chunks that a worker remembers, and symbols in one of them, at most.
CACHED, REMEMBERED = 300_000, 64
#: Symbols of a chunk whose agenda is a column of a matrix; cells of such a matrix.
WIDEST, CELLS = 1024, 1 << 21
#: Occurrences of chunks that are encoded at a time, and characters that are cut into chunks at a time.
BLOCK, STRETCH = 200_000, 1 << 20
SPACE = "▁"
_CHUNK = re.compile(" +[^ ]*|[^ ]+")
_NONE = np.int32(0x7FFFFFFF)
_MASK = 0xFFFFFFFFFFFFFFFF
_MID, _END, _STEP = 21, 42, 0x9E3779B97F4A7C15


class Vocabulary:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        plain = [i for i, p in enumerate(self.pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.of = {self.pieces[i]: i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.of) or len(self.bytes) != 256:
            raise ValueError("chunks are not independent in this vocabulary")
        if any(c not in self.of for p in self.of for c in p):
            raise ValueError("a character of a piece is no piece in this vocabulary")
        special = {i for i in range(len(self.pieces)) if model.is_control(i) or model.is_unknown(i)}
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.spelled = [byte_of.get(i) or (b"" if i in special else p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]
        self.first = {c: (self.of[c],) for p in self.of for c in p} | {" ": (self.of[SPACE],)}
        self.first[SPACE] = tuple(self.bytes[b] for b in SPACE.encode())
        _, order = np.unique([-model.get_score(i) for i in range(len(self.pieces))], return_inverse=True)
        self.order = order.astype(np.int32)
        self.joined = {(self.of[p[:i]], self.of[p[i:]]): whole for p, whole in self.of.items() for i in range(1, len(p)) if p[:i] in self.of and p[i:] in self.of}
        self._tabulate()

    def _tabulate(self) -> None:
        """The pairs as a table by hash; the few that find their place taken are kept in order beside it."""
        n = len(self.joined)
        pairs = np.array(list(self.joined), np.int64).reshape(n, 2)
        keys, whole = (pairs[:, 0] << 32) | pairs[:, 1], np.array(list(self.joined.values()), np.int32)
        self.shift = U(64 - max(16, int(n).bit_length() + 3))
        spot = self._spot(keys)
        self.keys, self.whole = np.full(1 << (64 - int(self.shift)), -1, np.int64), np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.keys[spot], self.whole[spot] = keys, whole
        lost = self.keys[spot] != keys
        self.crowded = np.zeros(len(self.keys), bool)
        self.crowded[spot[lost]] = True
        by = np.argsort(keys[lost])
        self.more_keys, self.more_whole = keys[lost][by], whole[lost][by]

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * U(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each two symbols make; -1 where there is none."""
        keys = (a.astype(np.int64) << 32) | b
        spot = self._spot(keys)
        same = self.keys[spot] == keys
        out = np.where(same, self.whole[spot], np.int32(-1))
        ask = np.flatnonzero(~same & self.crowded[spot])
        if len(ask):
            at = np.minimum(np.searchsorted(self.more_keys, keys[ask]), len(self.more_keys) - 1)
            out[ask] = np.where(self.more_keys[at] == keys[ask], self.more_whole[at], -1)
        return out

    def symbols(self, chunk: str) -> list[int]:
        """One symbol for each character of a piece, byte pieces for the others."""
        out: list[int] = []
        first = self.first
        for c in chunk:
            found = first.get(c)
            out += found if found is not None else [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Dropout:
    """Which candidates are skipped, by hash."""

    def __init__(self, rate: float, seed: int) -> None:
        self.below = min(_MASK, int(max(0.0, rate) * 2.0**64))
        self.seed = seed & _MASK

    def keys(self, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A key for each occurrence of a chunk."""
        return mix(mix(doc.astype(np.uint64) ^ mix(np.array([self.seed], np.uint64))) + place.astype(np.uint64) * U(_STEP))

    def skips(self, keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return mix(keys ^ (bounds * U(_STEP))) < U(self.below)

    def skips_one(self, key: int, bounds: int) -> bool:
        """skips() of one candidate, in plain integers."""
        x = key ^ (bounds * _STEP & _MASK)
        x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & _MASK
        x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & _MASK
        return x ^ (x >> 33) < self.below


def wide_bounds(i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A candidate's bounds as one number: side by side, or folded one after the other where they have no room."""
    i, j, end = (x.astype(np.uint64) for x in (i, j, end))
    return np.where(end < U(1 << _MID), i | (j << U(_MID)) | (end << U(_END)), mix(mix(mix(i) + j) + end))


def _wide_bounds(i: int, j: int, end: int) -> int:
    if end < 1 << _MID:
        return i | (j << _MID) | (end << _END)
    return int(wide_bounds(*(np.array([x]) for x in (i, j, end)))[0])


def agendas(vocab: Vocabulary, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None, dropout: Dropout, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merges the columns of symbols, of which each begins with `sizes` symbols; the ids one column after the other, and how
    many each has. Without keys nothing is skipped. `seen` takes (column, bounds) of the candidates."""
    width, n = symbols.shape
    out = np.full((n, width), -1, np.int32)
    column = np.arange(n)
    state = symbols.astype(np.int32)
    row = np.arange(width, dtype=np.int16)[:, None]
    ahead, behind = np.repeat(row + np.int16(1), n, axis=1), np.repeat(row - np.int16(1), n, axis=1)
    urgent, whole = np.full((width, n), _NONE), np.zeros((width, n), np.int32)

    def offer(i: np.ndarray, j: np.ndarray, at: np.ndarray) -> None:
        joined = vocab.join(state[i, at], state[j, at])
        ok = np.flatnonzero(joined >= 0)
        i, j, at, joined = i[ok], j[ok], at[ok], joined[ok]
        if keys is not None or seen is not None:
            bounds = i.astype(np.uint64) | (j.astype(np.uint64) << U(_MID)) | (ahead[j, at].astype(np.uint64) << U(_END))
            if seen is not None:
                seen.append((column[at], bounds))
            if keys is not None:
                kept = np.flatnonzero(~dropout.skips(keys[at], bounds))
                i, at, joined = i[kept], at[kept], joined[kept]
        urgent[i, at] = vocab.order[joined] * np.int32(WIDEST) + i.astype(np.int32)
        whole[i, at] = joined

    begin, at = np.nonzero(np.arange(1, width)[:, None] < sizes[None, :])
    offer(begin, begin + 1, at)
    while len(column):
        best = urgent.min(axis=0)
        at = np.flatnonzero(best < _NONE)
        if 2 * len(at) < len(column):  # the finished leave
            done = np.flatnonzero(best == _NONE)
            out[column[done]] = state[:, done].T
            state, ahead, behind, urgent, whole = (np.ascontiguousarray(x[:, at]) for x in (state, ahead, behind, urgent, whole))
            sizes, column, best = sizes[at], column[at], best[at]
            keys = None if keys is None else keys[at]
            at = np.arange(len(column))
            if not len(at):
                break
        i = (best[at] % WIDEST).astype(np.int64)
        j = ahead[i, at].astype(np.int64)
        after, before = ahead[j, at], behind[i, at]
        state[i, at], state[j, at] = whole[i, at], -1
        urgent[i, at] = urgent[j, at] = _NONE
        ahead[i, at] = after
        right, left = np.flatnonzero(after < sizes[at]), np.flatnonzero(before >= 0)
        behind[after[right], at[right]] = i[right]
        urgent[before[left], at[left]] = _NONE
        offer(np.concatenate([i[right], before[left].astype(np.int64)]), np.concatenate([after[right].astype(np.int64), i[left]]), np.concatenate([at[right], at[left]]))
    full = out >= 0
    return out[full], full.sum(axis=1)


def merge_long(vocab: Vocabulary, symbols: list[int], dropout: Dropout, key: int | None) -> list[int]:
    """The same for one chunk of any length, by a heap; without a key nothing is skipped."""
    n = len(symbols)
    ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
    dropped = key is not None and dropout.below > 0

    flat, begin = np.array(symbols, np.int32), np.arange(max(0, n - 1))
    whole = vocab.join(flat[:-1], flat[1:])
    offered = whole >= 0
    if dropped:
        offered &= ~dropout.skips(np.array([key], np.uint64), wide_bounds(begin, begin + 1, begin + 2))
    begin, whole = begin[offered], whole[offered]
    agenda = list(zip(vocab.order[whole].tolist(), begin.tolist(), (begin + 1).tolist(), (begin + 2).tolist(), whole.tolist(), strict=True))
    heapq.heapify(agenda)
    joined, order = vocab.joined, vocab.order.tolist()

    def offer(i: int, j: int) -> None:
        found = joined.get((symbols[i], symbols[j]))
        if found is not None and not (dropped and dropout.skips_one(key, _wide_bounds(i, j, ahead[j]))):
            heapq.heappush(agenda, (order[found], i, j, ahead[j], found))

    while agenda:
        _, i, j, end, found = heapq.heappop(agenda)
        if symbols[i] < 0 or symbols[j] < 0 or ahead[i] != j or ahead[j] != end:
            continue
        symbols[i], symbols[j], ahead[i] = found, -1, end
        if end < n:
            behind[end] = i
            offer(i, end)
        if behind[i] >= 0:
            offer(behind[i], i)
    return [s for s in symbols if s >= 0]


def _spread(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places low, low + 1, ... of each range, one range after the other."""
    upto = np.cumsum(count)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(low - (upto - count), count)


class Ragged:
    """Rows of different lengths in one array."""

    def __init__(self, dtype) -> None:
        self.flat, self.at = np.zeros(0, dtype), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype, copy=False)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])

    def counts(self, rows: np.ndarray) -> np.ndarray:
        return self.at[rows + 1] - self.at[rows]

    def places(self, rows: np.ndarray) -> np.ndarray:
        return _spread(self.at[rows], self.counts(rows))


class Book:
    """Numbered chunks with their symbols, plain ids and the candidates of the plain agenda; nothing of it depends on dropout."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.start()

    def start(self) -> None:
        self.number: dict[str, int] = {}
        self.symbols, self.ids, self.bounds = Ragged(np.int32), Ragged(np.int32), Ragged(np.uint64)

    def learn(self, chunks: Sequence[str]) -> None:
        """Adds chunks that have no number yet."""
        all_ = [self.vocab.symbols(c) for c in chunks]
        sizes = np.array([len(s) for s in all_], np.int64)
        flat = np.array([x for s in all_ for x in s], np.int32)
        starts = np.cumsum(sizes) - sizes
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        ids: list[tuple[np.ndarray, np.ndarray]] = []
        for some in _by_width(sizes):
            new: list[tuple[np.ndarray, np.ndarray]] = []
            got, counts = agendas(self.vocab, _columns(flat, starts[some], sizes[some]), sizes[some], None, Dropout(0, 0), new)
            ids.append((np.repeat(some, counts), got))
            seen += [(some[c], b) for c, b in new]
        for ragged, found in ((self.ids, ids), (self.bounds, seen)):
            owner = np.concatenate([o for o, _ in found])
            ragged.add(np.concatenate([x for _, x in found])[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(chunks)))
        self.symbols.add(flat, sizes)
        for c in chunks:
            self.number[c] = len(self.number)


def _by_width(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The rows in groups of like size, each small enough for one matrix."""
    width = np.maximum(3, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        step = max(1, CELLS >> int(w))
        yield from (rows[k : k + step] for k in range(0, len(rows), step))


def _columns(flat: np.ndarray, low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of flat as columns, -1 below."""
    out = np.full((int(sizes.max()), len(sizes)), -1, np.int32)
    upto = np.cumsum(sizes)
    out[np.arange(upto[-1]) - np.repeat(upto - sizes, sizes), np.repeat(np.arange(len(sizes)), sizes)] = flat[_spread(low, sizes)]
    return out


@cache
def book(path: str) -> Book:
    return Book(vocabulary(path))


def stretches(text: str) -> Iterator[str]:
    """The text in parts of about STRETCH characters, cut where a chunk begins."""
    low = 0
    while len(text) - low > STRETCH:
        high = low + STRETCH
        while (high := text.find(" ", high)) >= 0 and text[high - 1] == " ":
            high += 1
        if high < 0:
            break
        yield text[low:high]
        low = high
    yield text[low:]


class Encoder:
    """Encodes texts; encoders of one vocabulary share its book."""

    def __init__(self, path: str = MODEL, rate: float = RATE, seed: int = SEED) -> None:
        self.vocab, self.book = vocabulary(path), book(path)
        self.dropout = Dropout(rate, seed)

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        return self.encode_many([text], [key])[0][0]

    def encode_many(self, texts: Sequence[str], keys: Sequence[int]) -> tuple[list[np.ndarray], list[int]]:
        """Each text's ids, and how many it has without dropout."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        plain = [0] * len(texts)
        held: list[tuple[int, int, list[str]]] = []  # text, number of its first chunk, chunks
        size = 0

        def flush() -> None:
            docs = [keys[t] & _MASK for t, _, _ in held]
            for (t, _, _), ids, n in zip(held, *self._block(docs, [p for _, p, _ in held], [c for _, _, c in held]), strict=True):
                found[t].append(ids)
                plain[t] += n

        for t, text in enumerate(texts):
            place = 0
            for part in stretches(f" {text}") if text else ():
                chunks = _CHUNK.findall(part)
                for low in range(0, len(chunks), BLOCK):
                    held.append((t, place + low, chunks[low : low + BLOCK]))
                    size += len(held[-1][2])
                    if size >= BLOCK:
                        flush()
                        held, size = [], 0
                place += len(chunks)
        if held:
            flush()
        return [f[0] if len(f) == 1 else np.concatenate([np.zeros(0, np.int32), *f]) for f in found], plain

    def _block(self, docs: list[int], places: list[int], chunks: list[list[str]]) -> tuple[list[np.ndarray], list[int]]:
        """The ids of each list of chunks, which stand in a document from a place on."""
        if len(self.book.number) > CACHED:
            self.book.start()
        sizes = np.array([len(c) for c in chunks], np.int64)
        flat = [c for own in chunks for c in own]
        rows = self._numbers(flat)
        place = np.concatenate([np.arange(p, p + n) for p, n in zip(places, sizes.tolist(), strict=True)])
        keys = self.dropout.keys(np.repeat(np.array(docs, np.uint64), sizes), place)
        b = self.book
        pool, filled = [b.ids.flat], len(b.ids.flat)
        counts, low = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        known, other = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
        counts[known], low[known] = b.ids.counts(rows[known]), b.ids.at[rows[known]]
        plain = counts.copy()

        def place_ids(which: np.ndarray, got: np.ndarray, new: np.ndarray) -> None:
            nonlocal filled
            pool.append(got)
            counts[which], low[which] = new, filled + np.cumsum(new) - new
            filled += len(got)

        if self.dropout.below:
            owner = np.repeat(known, b.bounds.counts(rows[known]))
            varied = np.zeros(len(rows), bool)
            varied[owner[self.dropout.skips(keys[owner], b.bounds.flat[b.bounds.places(rows[known])])]] = True
            which = np.flatnonzero(varied)
            starts, n = b.symbols.at[rows[which]], b.symbols.counts(rows[which])
            for some in _by_width(n):
                place_ids(which[some], *agendas(self.vocab, _columns(b.symbols.flat, starts[some], n[some]), n[some], keys[which[some]], self.dropout))
        for k in other.tolist():  # too long to be remembered
            symbols, key = self.vocab.symbols(flat[k]), keys[k : k + 1]
            ids = unskipped = self._long(symbols, None)
            if self.dropout.below:
                ids = self._long(symbols, key)
            plain[k] = len(unskipped)
            place_ids(np.array([k]), ids, np.array([len(ids)]))
        ids = np.concatenate(pool)[_spread(low, counts)]
        ends = np.cumsum(sizes)
        cuts = np.concatenate([[0], np.cumsum(counts)])[ends]
        upto = np.concatenate([[0], np.cumsum(plain)])
        return np.split(ids, cuts[:-1]), (upto[ends] - upto[ends - sizes]).tolist()

    def _long(self, symbols: list[int], key: np.ndarray | None) -> np.ndarray:
        if len(symbols) <= WIDEST:
            return agendas(self.vocab, np.array(symbols, np.int32)[:, None], np.array([len(symbols)]), key, self.dropout)[0]
        return np.array(merge_long(self.vocab, list(symbols), self.dropout, None if key is None else int(key[0])), np.int32)

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """Each chunk's number in the book; -1 for those that are too long for it."""
        number = self.book.number
        found = list(map(number.get, chunks))
        if None in found:
            if new := list(dict.fromkeys(c for c, n in zip(chunks, found, strict=True) if n is None and len(c) <= REMEMBERED)):
                self.book.learn(new)
            found = [number.get(c, -1) if n is None else n for c, n in zip(chunks, found, strict=True)]
        return np.array(found, np.int64)

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are joined and read as UTF-8, marks are spaces, the first of which is dropped."""
        spelled = self.vocab.spelled
        return b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")[1:]


@cache
def encoder(path: str, rate: float, seed: int) -> Encoder:
    return Encoder(path, rate, seed)


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    """A list column; None is null."""
    sizes = np.array([0 if i is None else len(i) for i in ids], np.int64)
    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    values = np.concatenate([np.zeros(0, np.int32), *(i for i in ids if i is not None)])
    return pa.ListArray.from_arrays(at, pa.array(values), mask=pa.array([i is None for i in ids]))


def _mapped(docs: DataFrame, names: list[tuple[str, str]], derive) -> DataFrame:
    """docs with columns of derive(part); a part is cut into pieces of a bounded number of rows."""
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{n} {d}" for n, d in names)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for low in range(0, part.num_rows, 1000):
                some = part.slice(low, 1000)
                yield pa.RecordBatch.from_arrays([*some.columns, *derive(some)], [*some.schema.names, *(n for n, _ in names)])
        common.give_back()

    return docs.mapInArrow(run, ddl)


def encode(docs: DataFrame, path: str = MODEL, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, ...) with `ids`."""
    docs = common.without(docs, "ids")
    at, key = docs.columns.index("text"), docs.columns.index("doc_id")

    def derive(part: pa.RecordBatch) -> list[pa.Array]:
        texts = part.column(at).to_pylist()
        ids, _ = encoder(path, rate, seed).encode_many([t or "" for t in texts], [i or 0 for i in part.column(key).to_pylist()])
        return [_lists([None if t is None else i for t, i in zip(texts, ids, strict=True)])]

    return _mapped(docs, [("ids", "array<int>")], derive)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """encoded(ids, ...) with `decoded`."""
    encoded = common.without(encoded, "decoded")
    at = encoded.columns.index("ids")

    def derive(part: pa.RecordBatch) -> list[pa.Array]:
        enc = encoder(path, 0.0, 0)
        return [pa.array([None if i is None else enc.decode(i) for i in part.column(at).to_pylist()], pa.string())]

    return _mapped(encoded, [("decoded", "string")], derive)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids with dropout and without, read back: lossless must be true for every row."""
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    names = [("n_tokens", "long"), ("n_plain", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("lossless", "boolean")]

    def derive(part: pa.RecordBatch) -> list[pa.Array]:
        enc = encoder(MODEL, RATE, SEED)
        texts = [t or "" for t in part.column(1).to_pylist()]
        ids, plain = enc.encode_many(texts, [i or 0 for i in part.column(0).to_pylist()])
        back = [enc.decode(i.tolist()) for i in ids]
        return [
            pa.array([len(i) for i in ids], pa.int64()),
            pa.array(plain, pa.int64()),
            pa.array([hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids], pa.string()),
            pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()),
            pa.array([b == t for b, t in zip(back, texts, strict=True)], pa.bool_()),
        ]

    return _mapped(docs, names, derive).drop("text")
