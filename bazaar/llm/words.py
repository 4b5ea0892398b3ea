"""Words of whole Arrow batches as numpy arrays: positions and 64-bit hashes, without a Python loop over words.

A word's hash is a polynomial over its bytes modulo 2**64 (random value for each byte, odd base),
taken from running sums, so that every word of a batch is hashed at once, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK = 1 << 20

_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2**64 for i from 0 to n at least; kept for reuse."""
    have = _tables.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        have = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
        _tables[base] = have
    return have


def separators(pattern: bytes) -> np.ndarray:
    """Which bytes (0 to 255) are in pattern."""
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(pattern, dtype=np.uint8)] = True
    return out


#: \x20 and \x09-\x0D
SPACE = separators(b" \t\n\x0b\x0c\r")
#: ASCII other than digits and letters; bytes over 0x7F belong to words
NOT_ALNUM = separators(bytes(i for i in range(128) if not chr(i).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of about CHUNK bytes. Null is empty."""
    n = len(text)
    if not n:
        return
    if pa.types.is_large_string(text.type):
        kind = np.int64
    else:
        kind = np.int32
    _, off, data = text.buffers()
    at = np.frombuffer(off, dtype=kind)[text.offset : text.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if text.null_count:
        size = np.where(text.is_null().to_numpy(zero_copy_only=False), 0, np.diff(at))
        if size.sum() != at[-1] - at[0]:  # nulls with bytes below them
            return (yield from chunks(text.fill_null("")))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def spans(raw: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs of bytes outside sep, none crossing a row's bounds."""
    n = len(raw)
    inside = np.empty(n + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(sep[raw], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] |= inside[1:-1][cuts]
    last[cuts - 1] |= inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, start, end


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each raw[start:end]."""
    up, down = powers(_P, len(raw))
    c = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=c[1:])
    return mix((c[end] - c[start]) * down[start])


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each n consecutive words of one row."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(_Q, len(h))
    c = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=c[1:])
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return at, mix((c[at + n] - c[at]) * down[at])


class Index:
    """Open-addressing table from unsigned integers, of 32 or 64 bits, to their places; looks up whole arrays."""

    def __init__(self, keys: np.ndarray):
        kind = keys.dtype.type
        bits = max(4, int(len(keys) * 3 // 2 + 1).bit_length())
        size = 1 << bits
        self.mask = kind(size - 1)
        self.keys = np.zeros(size, dtype=kind)
        self.place = np.full(size, -1, dtype=np.int32)
        left, slot, self.probes = np.arange(len(keys), dtype=np.int32), keys & self.mask, 1
        while len(left):
            free = self.place[slot] < 0
            _, one = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[one]
            self.place[slot[won]], self.keys[slot[won]] = left[won], keys[left[won]]
            rest = np.ones(len(left), dtype=bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + kind(1)) & self.mask
            self.probes += bool(len(left))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if unknown."""
        kind = self.keys.dtype.type
        slot = keys & self.mask
        place = self.place[slot]
        out = np.where(self.keys[slot] == keys, place, -1)
        open_ = np.flatnonzero((out < 0) & (place >= 0))
        for i in range(1, self.probes):
            if not len(open_):
                break
            slot = (keys[open_] + kind(i)) & self.mask
            place = self.place[slot]
            hit = (self.keys[slot] == keys[open_]) & (place >= 0)
            out[open_[hit]] = place[hit]
            open_ = open_[~hit & (place >= 0)]
        return out
