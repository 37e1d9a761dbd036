"""Chat formatting: token-level assembly of conversations.

Each segment (a turn's text) is encoded on its own with a byte-level BPE; the template's marks are reserved ids beyond the
vocabulary, spliced between segments, so no text can ever produce one. Control strings inside a text are escaped
reversibly, so the formatted string can be parsed too. The loss mask comes from a prefix sum over segment boundaries.

Scale: rows are encoded where they lie; then encoded segments (not texts) are dealt by conversation and sorted, and both
assembly and reading back stream over the sorted rows: a conversation of any length is written in chunks of at most
CHUNK ids, so no conversation is held whole.

Defined cases: null role and null text are empty; a null conv_id is one conversation of its own; equal turns are ordered by
role, then text; repeated rows are repeated turns; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public word pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Control strings of the template; their ids follow the vocabulary in this order.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[OUT]", "[ROLE]", "[/ROLE]")
FIRST_ID = 50_257
BOS, END, USER, USER_END, SYSTEM, SYSTEM_END, ASSISTANT, ROLE, ROLE_END = (FIRST_ID + i for i in range(len(CONTROLS)))
OPEN = {"user": USER, "system": SYSTEM, "assistant": ASSISTANT}
CLOSE = {USER: USER_END, SYSTEM: SYSTEM_END, ASSISTANT: END, ROLE_END: END}
CHUNK = 8192

_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")


def escape(text: str) -> str:
    """A backslash after the first character of each control string; one more where there are some already."""
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("kerbside-chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def marks(role: str) -> tuple[int, int]:
    """The ids that open and close a turn; any other role is spelled out between ROLE and ROLE_END."""
    start = OPEN.get(role, ROLE_END)
    return start, CLOSE[start]


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("ids", pa.list_(pa.int32())), ("chars", pa.int64()), ("order", pa.binary())])
SEGMENTS_DDL = "conv_id long, turn long, role string, ids array<int>, chars long, order binary"
CHUNKS = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))])
CHUNKS_DDL = "conv_id long, chunk long, ids array<int>, loss_mask array<tinyint>"
READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())])
READ_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def encode_segments(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every turn's escaped text as ids, on its own."""

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for part in parts:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                plain = escape(text or "")
                rows.append((conv, turn, role or "", enc.encode_ordinary(plain), len(plain), hashlib.sha256((text or "").encode()).digest()))
            if rows:
                yield common.record_batch(SEGMENTS, rows)

    chosen = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return chosen.mapInArrow(encode, SEGMENTS_DDL)


def _segments(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for part in parts:
        ids = part.column("ids")
        flat, at = ids.values.to_numpy(), ids.offsets.to_numpy()
        for i, (conv, role) in enumerate(zip(part.column("conv_id").to_pylist(), part.column("role").to_pylist(), strict=True)):
            yield conv, role, flat[at[i] : at[i + 1]]


def assemble(segments: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Chunks of ids and loss mask, in order within their partition. The mask is 1 over each assistant text and its end mark."""

    def splice(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        nothing = object()
        conv, chunk, ids, mask, held = nothing, 0, [], [], 0

        def full(last: bool) -> Iterator[tuple]:
            nonlocal ids, mask, held, chunk
            a, m = np.concatenate(ids), np.concatenate(mask)
            end = len(a) if last else len(a) // CHUNK * CHUNK
            for i in range(0, end, CHUNK):
                yield conv, chunk, a[i : min(i + CHUNK, end)], m[i : min(i + CHUNK, end)]
                chunk += 1
            ids, mask, held = [a[end:]], [m[end:]], len(a) - end

        def rows() -> Iterator[tuple]:
            nonlocal conv, chunk, ids, mask, held
            for at, role, body in _segments(parts):
                if at != conv or conv is nothing:
                    if conv is not nothing:
                        yield from full(True)
                    conv, chunk, ids, mask, held = at, 0, [np.array([BOS], np.int32)], [np.zeros(1, np.int8)], 1
                start, end = marks(role)
                head = [start] if start != ROLE_END else [ROLE, *enc.encode_ordinary(escape(role)), ROLE_END]
                pieces = [np.array(head, np.int32), body, np.array([end], np.int32)]
                steps = np.zeros(sum(map(len, pieces)) + 1, np.int8)
                if start == ASSISTANT:  # +1 where the loss begins, -1 past its end: the prefix sum is the mask
                    steps[len(head)] += 1
                    steps[-1] -= 1
                ids += pieces
                mask.append(np.cumsum(steps[:-1], dtype=np.int8))
                held += len(steps) - 1
                if held >= CHUNK:
                    yield from full(False)
            if conv is not nothing:
                yield from full(True)

        yield from common.batches(CHUNKS, rows(), 500, weigh=lambda r: 5 * len(r[2]))

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "order").select("conv_id", "turn", "role", "ids", "chars", "order").mapInArrow(splice, CHUNKS_DDL)


def read_back(chunks: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each conversation, from ids and mask alone. The chunks of a conversation must lie together, in order."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)

        def stream() -> Iterator[tuple]:
            for part in parts:
                ids, mask = part.column("ids"), part.column("loss_mask")
                at = ids.offsets.to_numpy()
                flat, loss = ids.values.to_numpy(), mask.values.to_numpy()
                for i, (conv, chunk) in enumerate(zip(part.column("conv_id").to_pylist(), part.column("chunk").to_pylist(), strict=True)):
                    yield conv, chunk, flat[at[i] : at[i + 1]], loss[at[i] : at[i + 1]]

        state: _Conversation | None = None

        def rows() -> Iterator[tuple]:
            nonlocal state
            for conv, chunk, ids, loss in stream():
                if chunk == 0:
                    if state:
                        yield state.row()
                    state = _Conversation(conv, enc)
                state.take(ids, loss)
            if state:
                yield state.row()

        yield from common.batches(READ, rows())

    return chunks.mapInArrow(read, READ_DDL)


class _Conversation:
    """Parses a conversation's ids; holds one turn at a time."""

    def __init__(self, conv, enc) -> None:
        self.conv, self.enc = conv, enc
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_tokens = self.n_loss = 0
        self.open: int | None = None
        self.role = ""
        self.ids: list[np.ndarray] = []
        self.mask: list[np.ndarray] = []

    def take(self, ids: np.ndarray, mask: np.ndarray) -> None:
        self.n_tokens += len(ids)
        self.n_loss += int(mask.sum())
        at = 0
        for i in np.flatnonzero(ids >= FIRST_ID):
            self.ids.append(ids[at:i])
            self.mask.append(mask[at:i])
            self.mark(int(ids[i]))
            at = i + 1
        self.ids.append(ids[at:])
        self.mask.append(mask[at:])

    def mark(self, token: int) -> None:
        self.chars += len(CONTROLS[token - FIRST_ID])
        ids, mask = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (self.ids, self.mask))
        self.ids, self.mask = [], []
        if token == ROLE_END:
            plain = self.enc.decode_bytes(ids.tolist()).decode()
            self.chars += len(plain)
            self.role, self.open = unescape(plain), ROLE_END
        elif token in (USER, SYSTEM, ASSISTANT):
            self.open = token
            self.role = next(r for r, t in OPEN.items() if t == token)
        elif self.open is not None and token == CLOSE[self.open]:
            plain = self.enc.decode_bytes(ids.tolist()).decode()
            text = unescape(plain)
            self.chars += len(plain)
            self.n_turns += 1
            self.turns.update(f"{self.role}\n{text}\n".encode())
            kept = text if len(ids) and mask.all() else unescape(self.enc.decode_bytes(ids[mask.astype(bool)].tolist()).decode())
            self.loss_chars += len(kept)
            self.loss.update(kept.encode())
            self.open = None

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.n_tokens, self.n_loss


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L conv_id, 0L turn, 'user' role, '{tricky}' text UNION ALL SELECT -7L, 1L, 'assistant', '{tricky}'")
    return read_back(assemble(encode_segments(turns.unionByName(more)))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: The same rows from the texts: one more character for each control string or escaped one in a text, and the marks.
SQL = r"""WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations UNION ALL
  SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, LENGTH(text) + LEN(REGEXP_EXTRACT_ALL(text, '[<\[]\\*(?:s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|OUT\]|ROLE\]|/ROLE\])')) +
  CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 9 ELSE 17 + LENGTH(role) END AS n FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, COUNT(*) AS n_turns, SHA256(STRING_AGG(role || CHR(10) || text || CHR(10), '' ORDER BY turn, role, SHA256(text))) AS turns_sha256,
  CAST(COALESCE(SUM(CASE WHEN role = 'assistant' THEN LENGTH(text) END), 0) AS BIGINT) AS loss_chars,
  SHA256(COALESCE(STRING_AGG(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, SHA256(text)), '')) AS loss_sha256,
  CAST(3 + SUM(n) AS BIGINT) AS formatted_chars FROM m GROUP BY conv_id"""
