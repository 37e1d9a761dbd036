"""Words and shingles of UTF-8 texts as 64-bit hashes, straight from Arrow buffers.

Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. A word's hash is a polynomial over its bytes,
taken from one prefix sum over a piece of text; a shingle's hash folds the hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer run without white space makes a longer piece.
PIECE = 1 << 20
SHINGLE = 5

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = U(0xC2B2AE3D27D4EB4F)


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), PIECE)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                table = np.full(size, U(base & 0xFFFFFFFFFFFFFFFF))
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))
        return self.up, self.down


_powers = _Powers()
powers = _powers.upto


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and where each text begins and ends in them; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    bounds = np.frombuffer(at, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if at else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def _pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts between texts or at white space, about PIECE bytes apart."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + PIECE, n)
        if end < n:
            k = int(np.searchsorted(bounds, end, "right")) - 1
            if bounds[k] > at:
                end = int(bounds[k])
            else:
                gaps = np.flatnonzero(_SPACE[data[at:end]])
                while not len(gaps) and end < int(bounds[k + 1]):
                    end = min(2 * end - at, int(bounds[k + 1]))
                    gaps = np.flatnonzero(_SPACE[data[at:end]])
                end = at + int(gaps[-1]) + 1 if len(gaps) else end
        yield at, end
        at = end


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every word's hash, the words in each text as bounds into them, and each word's first byte."""
    hashes, starts_at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, high in _pieces(data, bounds):
        part = data[low:high]
        inside = np.empty(len(part) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(_SPACE[part], out=inside[1:-1])
        begin = inside[1:-1] & ~inside[:-2]
        final = inside[1:-1] & ~inside[2:]
        cuts = bounds[np.searchsorted(bounds, low, "right") : np.searchsorted(bounds, high, "left")] - low
        begin[cuts] |= inside[1:-1][cuts]
        final[cuts - 1] |= inside[1:-1][cuts - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(final) + 1
        up, down = _powers.upto(len(part))
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts]))
        starts_at.append(starts + low)
    at = np.concatenate(starts_at)
    return np.concatenate(hashes), np.searchsorted(at, bounds), at


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles in order of hash; fewer words make one, none make none."""
    words, at, _ = word_hashes(*utf8(column))
    grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        grams = (grams ^ words[i : len(words) - k + 1 + i]) * _FOLD
        grams ^= grams >> U(29)
    grams = mix(grams)
    for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if high - low >= k:
            own = np.sort(grams[low : high - k + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif high > low:
            whole = U(high - low)
            for w in words[low:high]:
                whole = mix(np.array([whole ^ w]) * _FOLD)[0]
            yield np.array([whole], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
