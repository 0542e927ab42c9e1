"""Byte-level word segmentation and hashing of Arrow string columns with numpy.

Texts never become Python strings here: a chunk of texts is one UTF-8 byte buffer, words are runs of
bytes found by a 256-entry table, and a word's 64-bit hash comes from prefix sums of a polynomial
over the bytes, so the cost per byte is a few array operations whatever the word lengths are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
HASH_BYTES = 1 << 17
_MULT = 0x9E3779B97F4A7C15 | 1
_U64 = (1 << 64) - 1


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over text whose A-Z are lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Word bytes of ``[^\x20\x09-\x0D]+``.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[32] = NON_SPACE[9:14] = False


class Words(NamedTuple):
    """Words of a chunk: hash, the text (index in the chunk) they are in, and the byte range."""

    hashes: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    buffer: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i]:bounds[i + 1]


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20_11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _powers(n: int, base: int) -> np.ndarray:
    return _some_powers(2 * HASH_BYTES, base)[:n] if n <= 2 * HASH_BYTES else _more_powers(n, base)


@lru_cache(maxsize=2)
def _some_powers(n: int, base: int) -> np.ndarray:
    return _more_powers(n, base)


def _more_powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _run_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of buffer[start:end] for sorted, disjoint ranges; long buffers go in pieces between ranges."""
    out = np.empty(len(start), dtype=np.uint64)
    first = 0
    while first < len(start):
        origin = start[first]
        last = max(first + 1, int(np.searchsorted(end, origin + HASH_BYTES, "right")))
        piece = buffer[origin : end[last - 1]]
        size = len(piece) + 1
        with np.errstate(over="ignore"):
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(_byte_values()[piece] * _powers(size, _MULT)[: len(piece)], out=sums[1:])
            s, e = start[first:last] - origin, end[first:last] - origin
            value = (sums[e] - sums[s]) * _powers(size, pow(_MULT, -1, 1 << 64))[s]
            out[first:last] = mix(value ^ ((e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        first = last
    return out


def words_of(texts: list[bytes | memoryview], is_word: np.ndarray) -> Words:
    """Words of A-Z-lower-cased texts; ``is_word`` says which bytes belong to words."""
    joined = b" ".join([*texts, b""])
    buffer = LOWER[np.frombuffer(joined, dtype=np.uint8)]
    inside = is_word[buffer]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edges[::2], edges[1::2]
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    text_end = np.cumsum(sizes + 1)
    bounds = np.concatenate([[0], np.searchsorted(start, text_end, "left")]).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return Words(_run_hashes(buffer, start, end), text, start, end, buffer, bounds)


def utf8_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, list[memoryview]]]:
    """(index of the first text, UTF-8 views of texts) in chunks of about chunk_bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    kind, at = (np.int64, 8) if large else (np.int32, 4)
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    if data is None or data.size == 0:
        yield 0, [memoryview(b"")] * n
        return
    bounds = np.frombuffer(offsets, dtype=kind, count=n + 1, offset=column.offset * at).astype(np.int64)
    view = memoryview(data).cast("B")
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + chunk_bytes, "right")) - 1)
        last = min(last, n)
        yield first, [view[bounds[i] : bounds[i + 1]] if valid[i] else view[:0] for i in range(first, last)]
        first = last


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; with fewer words than size the
    whole sequence is one shingle; a text without words has none."""
    hashes, n = words.hashes, len(words.hashes)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, n - size + 1), dtype=np.uint64)
        for j in range(size):
            rolled = rolled * np.uint64(_MULT) + hashes[j : j + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(rolled[a : b - size + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            value = b - a
            for h in hashes[a:b].tolist():
                value = (value * 0x2545F4914F6CDD1D + h) & _U64
            out.append(mix(np.array([value], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
