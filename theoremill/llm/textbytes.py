"""Vectorised word and shingle hashing over the bytes of many texts at once (numpy, inside Arrow batches).

A word is a maximal run of bytes other than ASCII white space (0x09-0x0D, 0x20). UTF-8 continuation bytes are never
white space, so cutting bytes cuts characters nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (one longer text is worked on alone).
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_PLACE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All but letters, digits and bytes of non-ASCII characters.
NOT_ALNUM = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        up, down = np.full(n, _PLACE), np.full(n, _PLACE_INVERSE)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    raw: np.ndarray  # bytes as they are
    data: np.ndarray  # bytes, A-Z lowered
    offsets: np.ndarray  # of texts, n + 1
    starts: np.ndarray  # of words
    ends: np.ndarray
    first: np.ndarray  # word index at which each text begins, n + 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = _power_tables(len(self.data))
        running = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[self.data] * up[: len(self.data)], out=running[1:])
        return mix((running[self.ends] - running[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words_in(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE, joins: bytes = b"") -> Words:
    """between: marks the bytes that part words; joins: those of them that don't between two digits."""
    inside = ~between[raw]
    if joins and len(raw) > 2:
        digit = (raw >= 48) & (raw <= 57)
        inside[1:-1] |= np.isin(raw[1:-1], np.frombuffer(joins, np.uint8)) & digit[:-2] & digit[2:]
    begins = np.zeros(len(raw) + 1, bool)
    begins[offsets[:-1]] = True  # a text ends words even if the next one begins without white space
    prior = np.concatenate([[False], inside[:-1]]) & ~begins[:-1] if len(raw) else inside
    starts = np.flatnonzero(inside & ~prior)
    follow = np.concatenate([inside[1:], [False]]) & ~np.concatenate([begins[1:-1], [True]]) if len(raw) else inside
    ends = np.flatnonzero(inside & ~follow) + 1
    return Words(raw, LOWER[raw], offsets, starts, ends, np.searchsorted(starts, offsets))


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) for runs of rows of about `limit` bytes of text; null texts are empty."""
    raw, offsets = text_buffers(column)
    a = 0
    while a < len(column):
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, z, raw[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
        a = z


def chunks(column: pa.Array, between: np.ndarray = SPACE, joins: bytes = b"") -> Iterator[tuple[int, int, Words]]:
    """(from row, to row, words) for runs of rows of about CHUNK_BYTES of text; `between` marks the bytes that part words."""
    for a, z, raw, offsets in byte_chunks(column):
        yield a, z, words_in(raw, offsets, between, joins)


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of `size` words; with fewer words, of all of them as
    one; without words, none."""
    h = words.hashes()
    place = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    runs = np.zeros(0, np.uint64)
    if len(h) >= size:
        runs = h[: len(h) - size + 1] * place[0]
        for j in range(1, size):
            runs = runs + h[j : len(h) - size + 1 + j] * place[j]
        runs = mix(runs)
    out = []
    for a, z in zip(words.first[:-1], words.first[1:], strict=True):
        n = z - a
        if n >= size:
            out.append(np.unique(runs[a : z - size + 1]))
        elif n:
            out.append(mix(mix((h[a:z] * place[:n]).sum(dtype=np.uint64, keepdims=True)) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
