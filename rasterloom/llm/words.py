"""Vectorised words, hashes and shingles over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D. Its hash has 64 bits and chains its eight-byte blocks
through a mixer, which no sum of powers could be undone by; words of over LONG bytes take BLAKE2. Where equal hashes
must mean equal words, callers add a second hash under a key drawn for the run, or compare the words.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a batch's slice, and of the longest word that is hashed by blocks.
SLICE, LONG = 1 << 20, 256
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(column) else raw[:0], offsets - (offsets[0] if len(offsets) else 0)


def trim() -> None:
    """Hand freed memory back to the system: workers live on, and run the next operator's tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut to about so many bytes of text; one row at least."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    trim()


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and where each row's words begin (len(offsets) entries)."""
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    n = ends - starts
    out = mix((n.astype(np.uint64) + np.uint64(1)) * _ODD ^ np.uint64(seed))
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    blocks = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    by_length = np.argsort(np.minimum(n, LONG + 1).astype(np.uint16), kind="stable")
    by_length = by_length[: np.searchsorted(n[by_length], LONG, "right")]
    for k in range(0, LONG, 8):
        by_length = by_length[np.searchsorted(n[by_length], k, "right") :]
        if not len(by_length):
            break
        left = np.minimum(n[by_length] - k, 8).astype(np.uint64)
        block = blocks[starts[by_length] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        out[by_length] = mix(out[by_length] ^ block)
    for i in np.flatnonzero(n > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].data, digest_size=8, key=int(seed).to_bytes(8, "little")).digest(), "little")
    return out


def hashed_words(column: pa.Array, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a column, and where each row's words begin."""
    raw, offsets = buffers(column)
    if lower:
        raw = _LOWER[raw]
    starts, ends, rows = word_bounds(raw, offsets)
    return word_hashes(raw, starts, ends, seed), rows


def shingles(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in sequence and the row of each; a row of fewer words has one, its whole sequence."""
    n = np.diff(rows)
    row = np.repeat(np.arange(len(n)), n)
    left = np.repeat(rows[1:], n) - np.arange(len(h))  # words from here to the end of the row
    total = np.zeros(len(h), dtype=np.uint64)
    for j in range(k):
        part = np.zeros(len(h), dtype=np.uint64)
        part[: max(0, len(h) - j)] = h[j:]
        part[left <= j] = 0
        total = mix(total * _ODD + part)
    first = np.zeros(len(h), dtype=bool)
    first[rows[:-1][n > 0]] = True
    keep = (left >= k) | (first & (np.repeat(n, n) < k))
    return mix(total[keep] + np.repeat(np.minimum(n, k), n)[keep].astype(np.uint64)), row[keep]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sequences(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences h[start:end], chained word by word; sequences are short."""
    n = ends - starts
    out = mix(n.astype(np.uint64) + np.uint64(1))
    by_length = np.argsort(n, kind="stable")
    for j in range(int(n.max(initial=0))):
        by_length = by_length[np.searchsorted(n[by_length], j, "right") :]
        out[by_length] = mix(out[by_length] * _ODD + h[starts[by_length] + j])
    return out


def new_key() -> int:
    """A key for the hashes of one run, which no text can have been made for."""
    return secrets.randbits(63) | 1
