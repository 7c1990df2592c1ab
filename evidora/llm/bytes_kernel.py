"""Vectorised passes over the UTF-8 bytes of Arrow text batches: words, hashes and shingles without per-word Python."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
#: What a Python worker keeps from task to task, by name; one operator's at a time.
_kept: dict[str, object] = {}


def kept(name: str, make: Callable):
    """The worker's own object of this name, made when it is first asked for."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def give_back() -> None:
    """Return freed memory to the system: workers and the driver live on and share their machines' memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable, keep: str = "") -> Callable:
    """A function over batches that first drops what other operators kept in this worker, and at its end gives freed
    memory back."""

    def wrapped(batches):
        for name in [k for k in _kept if not keep or not k.startswith(keep)]:
            del _kept[name]
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE_CODE = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHINGLE_CODE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes that belong to words: digits, letters and everything beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The white space of [\x20\x09-\x0D].
SPACE_BYTE = np.zeros(256, bool)
SPACE_BYTE[[32, *range(9, 14)]] = True


STEP = 0x9E3779B97F4A7C15


def step(k: int) -> np.uint64:
    """The k-th multiple of an odd constant, to tell uses of one hash apart."""
    return np.uint64(k * STEP & (1 << 64) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, beyond, bytes, offsets from 0) of at most ``limit`` bytes, or one longer text by itself."""
    data, at = column_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``inside`` holds; no run crosses a text's end."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[at] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int | None = None) -> np.ndarray:
    """A 64-bit hash of each span's bytes, or of its first ``most`` bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    if most is not None:
        n = np.minimum(n, most)
    n = n.astype(np.int32)
    place = np.arange(int(n.sum()), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
    codes = BYTE_CODE[data[np.repeat(starts, n) + place]]
    place &= 4095
    codes *= PLACE_CODE[place]
    edges = np.cumsum(n) - n
    return mix(np.add.reduceat(codes, edges) + n.astype(np.uint64))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of all texts: lower-cased bytes, starts, ends, and the first word of each text (plus the end)."""
    low = LOWER[data]
    starts, ends = word_spans(WORD_BYTE[data], at)
    return low, starts, ends, np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row, and the first shingle of each text (plus the end).

    A text with 1 to ``size`` - 1 words has one shingle of all its words.
    """
    n_docs = len(first) - 1
    count = np.diff(first)
    short = (count > 0) & (count < size)
    n = np.where(short, 1, np.maximum(0, count - size + 1))
    edges = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(edges[-1]), np.uint64)
    if not len(out):
        return out, edges
    doc = np.repeat(np.arange(n_docs), n)
    start = first[doc] + (np.arange(len(out)) - edges[doc])
    beyond = first[doc + 1]
    for k in range(size):
        use = start + k < beyond
        out += np.where(use, hashes[np.minimum(start + k, len(hashes) - 1)] * SHINGLE_CODE[k], np.uint64(0))
    return mix(out), edges


def segment_min(values: np.ndarray, edges: np.ndarray, empty: int) -> np.ndarray:
    """Minimum of each segment; ``empty`` where a segment has no values."""
    out = np.full(len(edges) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(edges) > 0)
    if len(full):
        out[full] = np.minimum.reduceat(values, edges[full])
    return out


def fixed_binary(column: pa.Array, width: int, dtype=np.uint8) -> np.ndarray:
    """Rows of a binary column that all have ``width`` items."""
    data, at = column_bytes(column)
    return data[at[0] : at[-1]].view(dtype).reshape(len(column), width)


def binary_rows(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.dtype.itemsize
    at = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(rows.tobytes())])
