"""Whole-column text helpers for Arrow batches: bytes, words, shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = 32
#: A-Z to a-z, the white space of `[^\x20\x09-\x0D]+` to one space, all other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = SPACE
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xD6E8FEB86659FD93)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its len + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return body[at[0]:at[-1]], at - at[0]


def parts(column: pa.Array, limit: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> np.uint64(32))) * MIX2
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every folded word and, per document, the position of its first word (len + 1 values)."""
    body, at = raw(column)
    body = FOLD[body]
    word = body != SPACE
    first = np.zeros(len(body) + 1, bool)
    first[at] = True
    before = np.empty(len(body), bool)
    if len(body):
        before[0] = False
        before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    edges = np.append(starts, len(body)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(body)])
    coded = words.dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w.rstrip(b" ")) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy(zero_copy_only=False)], np.searchsorted(starts, at)


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its word shingles.

    A document with fewer words than `size` has one shingle, its whole sequence; one without words has none. Two
    different shingles share a 64-bit hash with probability 2^-64.
    """
    hashes, at = word_hashes(column)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled[:max(0, n - k)] = rolled[:max(0, n - k)] * MIX + hashes[k:]
    rolled = mixed(rolled)
    out = []
    for i in range(len(at) - 1):
        s, e = at[i], at[i + 1]
        if e - s >= size:
            out.append(np.unique(rolled[s:e - size + 1]))
        elif e > s:
            out.append(np.array([xxhash.xxh64_intdigest(hashes[s:e].tobytes(), seed=int(e - s))], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out
