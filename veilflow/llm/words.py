"""Words of whole Arrow string columns as 64-bit hashes, computed over the byte buffers without a Python object per word.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_CHUNK = 1 << 18
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D | 3
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            powers = np.full(_CHUNK + 1, base, dtype=np.uint64)
            powers[0] = 1
            _powers.append(np.cumprod(powers, dtype=np.uint64))
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows in them; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n + 1 word offsets of the rows."""
    space = SPACE[data]
    start = ~space
    end = start.copy()
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    start[first] = ~space[first]
    end[last] = ~space[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each word that depends on its bytes alone."""
    power, inverse = _power_tables()
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + _CHUNK, side="right"))
        if j <= i:  # a word longer than a chunk
            out[i] = xxhash.xxh64_intdigest(data[base : int(ends[i])].tobytes())
            i += 1
            continue
        piece = data[base : int(ends[j - 1])]
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[piece] * power[: len(piece)], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * inverse[s]
        i = j
    return mix(out)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * _U(0x9E3779B97F4A7C15) + (y ^ _U(0x632BE59BD9B4E019)) * _U(0xD6E8FEB86659FD93))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` consecutive words, by doubling."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, size = None, 0, h, 1
    while True:
        if length & size:
            part = power[done : done + n]
            out = part if out is None else _pair(out, part)
            done += size
        if done == length:
            return out
        power, size = _pair(power[:-size], power[size:]), size * 2


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``limit`` bytes of text, or one document."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j
