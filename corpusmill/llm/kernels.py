"""Numpy kernels over UTF-8 bytes: Arrow string columns as byte arrays, word spans and hashes, shingles, window hashes.

Hashes are polynomial sums modulo 2**64 over random byte values, finished with a bit mixer.  They depend on the
bytes alone, never on where a text was cut for processing.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Tables:
    """Built on first use in a worker: 2 x 8 MB."""

    power: np.ndarray | None = None
    inverse: np.ndarray | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _Tables.power is None or len(_Tables.power) < n:
        size = max(n, BLOCK + 4096)
        _Tables.power = _powers(_BASE, size)
        _Tables.inverse = _powers(pow(_BASE, -1, 1 << 64), size)
    return _Tables.power, _Tables.inverse


_rng = np.random.Generator(np.random.PCG64(20240501))
BYTE_VALUE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) | _U(1)
SECOND_VALUE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) | _U(1)
ORDER = _rng.integers(1, 1 << 63, size=64, dtype=np.uint64) | _U(1)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    at = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    data, at = utf8(column)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield data[a:b]


def prefix_sums(b: np.ndarray, value: np.ndarray) -> np.ndarray:
    power, _ = powers(len(b) + 1)
    out = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(value[b] * power[: len(b)], dtype=np.uint64, out=out[1:])
    return out


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside x20 and x09 to x0D."""
    edge = np.ones(len(b) + 2, dtype=np.int8)
    edge[1:-1] = SPACE[b]
    d = np.diff(edge)
    return np.flatnonzero(d == -1), np.flatnonzero(d == 1)


def _hash_block(b: np.ndarray, value: np.ndarray) -> np.ndarray:
    starts, ends = word_spans(b)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = prefix_sums(b, value)
    _, inverse = powers(len(b) + 1)
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * ORDER[0])
    for i in np.flatnonzero(ends - starts > BLOCK).tolist():  # by length alone, so that cuts don't matter
        h[i] = int.from_bytes(hashlib.blake2b(b[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def cuts(b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about BLOCK bytes that end at white space (longer only inside one long word)."""
    a, n = 0, len(b)
    while n - a > BLOCK:
        gaps = np.flatnonzero(SPACE[b[a : a + BLOCK]])
        if len(gaps):
            end = a + int(gaps[-1]) + 1
        else:
            end, step = a + BLOCK, BLOCK
            while end < n:
                gaps = np.flatnonzero(SPACE[b[end : end + step]])
                if len(gaps):
                    end += int(gaps[0]) + 1
                    break
                end += step
            end = min(end, n)
        yield a, end
        a = end
    if a < n or not n:
        yield a, n


def word_hashes(b: np.ndarray, lower: bool = True, value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order; with ``lower`` A-Z count as a-z."""
    parts = []
    for s, e in cuts(b):
        part = b[s:e]
        parts.append(_hash_block(LOWER[part] if lower else part, value))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles, repeats kept; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    if n < k:
        s = (words * ORDER[1 : n + 1]).sum(dtype=np.uint64, keepdims=True)
        return mix(s + np.array([n], np.uint64) * ORDER[40])
    s = words[: n - k + 1] * ORDER[1]
    for j in range(1, k):
        s = s + words[j : n - k + 1 + j] * ORDER[1 + j]
    return mix(s)


def window_hashes(b: np.ndarray, size: int, value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """Hashes of all windows of ``size`` bytes."""
    n = len(b) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(b, value)
    _, inverse = powers(len(b) + 1)
    return mix((sums[size:] - sums[:n]) * inverse[:n])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each window of ``size`` values, by prefix and suffix minima of blocks."""
    n = len(x)
    if size <= 1:
        return x
    if n < size:
        return x[:0]
    pad = -n % size
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]) if pad else x
    blocks = full.reshape(-1, size)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - size + 1], left[size - 1 : n])


def packed(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each part: its values of each column (eight bytes a value) as one binary."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    out = [pa.array(part[cut[:-1]].astype(np.int32))]
    for x in columns.values():
        raw = x[order].tobytes()
        out.append(pa.array([raw[8 * a : 8 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary()))
    return pa.RecordBatch.from_arrays(out, ["part", *columns])


def unpacked(table: pa.Table, name: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=dtype)


def give_back() -> None:
    """Freed memory goes back to the machine: numpy's and Arrow's allocators keep it, and a worker serves many tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving memory back when a task ends."""

    @functools.wraps(run)
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return mapped
