"""Vectorised text primitives on the UTF-8 buffers of Arrow string columns.

Every function works on a chunk: the concatenated bytes of some rows and their offsets. Nothing
here loops over characters or words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
MULT = 0x9E3779B97F4A7C15
INV = pow(MULT, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
FILTER_BITS = 26
FILTER_KEYS = 4


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and its inverse modulo 2**64 for i below n, kept per process."""
    if len(_POWERS.get("p", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("p", MULT), ("q", INV)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _POWERS[name] = np.multiply.accumulate(step)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def as_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.large_string())
    large = pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) so that a chunk has about limit bytes, one row at least."""
    raw, off = as_utf8(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII, Latin-1 letters and Cyrillic."""
    out = _LOWER[data]
    lead = np.flatnonzero((data == 0xC3) | (data == 0xD0))
    lead = lead[lead + 1 < len(data)]
    if len(lead):
        nxt = data[lead + 1]
        c3 = lead[(data[lead] == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)]
        out[c3 + 1] += 32
        d0 = data[lead] == 0xD0
        out[lead[d0 & (nxt >= 0x90) & (nxt <= 0x9F)] + 1] += 32
        hi = lead[d0 & (nxt >= 0xA0) & (nxt <= 0xAF)]
        out[hi] = 0xD1
        out[hi + 1] -= 32
    return out


_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_ALPHA[128:] = True
_ALNUM = _ALPHA.copy()
_ALNUM[48:58] = True


def word_mask(data: np.ndarray, digits: bool = False) -> np.ndarray:
    """Bytes that belong to words. Punctuation and symbols outside ASCII are not word bytes."""
    m = (_ALNUM if digits else _ALPHA)[data]
    n = len(data)
    e2 = np.flatnonzero(data == 0xE2)
    for k in (0, 1, 2):
        m[e2[e2 + k < n] + k] = False
    c2 = np.flatnonzero(data == 0xC2)
    for k in (0, 1):
        m[c2[c2 + k < n] + k] = False
    return m


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of mask; no run goes over a row's end."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] |= mask[inner]
    last[inner - 1] |= mask[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equals hash_word of the same bytes."""
    p, q = powers(len(data) + 1)
    acc = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=acc[1:])
    return (acc[end] - acc[start]) * q[start]


def hash_word(word: str | bytes) -> int:
    b = word.encode() if isinstance(word, str) else word
    h = 0
    for i, x in enumerate(b):
        h = (h + (x + 1) * pow(MULT, i, 1 << 64)) & 0xFFFFFFFFFFFFFFFF
    return h


def roll(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of width consecutive hashes (order matters); one per window start."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
    return out ^ (out >> np.uint64(32))


def member(h: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is in keys, index in keys); keys are sorted and unique."""
    if not len(keys):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    i = np.searchsorted(keys, h)
    i[i == len(keys)] = 0
    return keys[i] == h, i


class Bits:
    """A set of hashes as a bit filter of fixed size: no hash is ever missed; a foreign one is taken for a
    member with a probability below 1e-9 for 100,000 names and below 1 % for five million."""

    def __init__(self, blocks: np.ndarray | None = None, bits: np.ndarray | None = None):
        self.word = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
        if blocks is not None and len(blocks):
            np.bitwise_or.at(self.word, blocks, bits)

    @staticmethod
    def places(h: np.ndarray) -> np.ndarray:
        """Bit numbers of each hash, FILTER_KEYS a row."""
        x = h.astype(np.uint64)
        out = np.empty((len(x), FILTER_KEYS), dtype=np.int64)
        for k in range(FILTER_KEYS):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            out[:, k] = (x >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return out

    def add(self, h: np.ndarray) -> Bits:
        at = self.places(h).ravel()
        np.bitwise_or.at(self.word, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return self

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        live = np.arange(len(h))
        x = h.astype(np.uint64)
        for _ in range(FILTER_KEYS):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            at = (x >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            ok = (self.word[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            live, x = live[ok], x[ok]
            if not len(live):
                return out
        out[live] = True
        return out

    def __contains__(self, word: str) -> bool:
        return bool(self.has(np.array([hash_word(word)], np.uint64))[0])


def bit_rows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, bits) that the hashes set in a filter; rows of several batches are combined by bit_or."""
    at = Bits.places(h).ravel()
    block, inv = np.unique(at >> 6, return_inverse=True)
    bits = np.zeros(len(block), np.uint64)
    np.bitwise_or.at(bits, inv, np.uint64(1) << (at & 63).astype(np.uint64))
    return block, bits.view(np.int64)
