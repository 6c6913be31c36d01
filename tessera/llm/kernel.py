"""Vectorised byte kernels over Arrow string columns, shared by the operators of this package.

All of them see a run of rows as one byte array with row offsets, so the work
per word is a few numpy passes and never a Python call. A run holds about
``RUN_BYTES`` bytes (more only if a single text is longer), which bounds the memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20

#: Bytes that end a word: space and the controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Maps A-Z to a-z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_ARRAY = np.frombuffer(LOWER, np.uint8)

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, which: str = "up") -> np.ndarray:
    """The first n powers of an odd base modulo 2^64 ("down": of its inverse)."""
    if len(_powers[which]) < n:
        base = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, RUN_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which][:n]


def runs(column: pa.Array | pa.ChunkedArray, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string or binary column into runs: first row, row after the last, bytes, row offsets (nulls are empty)."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if chunk.null_count:
            chunk = chunk.fill_null("" if pa.types.is_string(chunk.type) or pa.types.is_large_string(chunk.type) else b"")
        wide = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        _, offsets, data = chunk.buffers()
        n = len(chunk)
        if not n:
            continue
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[chunk.offset : chunk.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + run_bytes, "right")) - 1))
            yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def words(a: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a run, and for each row (and one more) the index of its first word."""
    inside = ~breaks[a]
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(a)]
    begins[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    ends[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values so that all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(a: np.ndarray) -> np.ndarray:
    """Sums from which span_hash takes the hash of any byte span."""
    c = np.empty(len(a) + 1, np.uint64)
    c[0] = 0
    np.cumsum(_BYTE[a] * powers(len(a)), out=c[1:])
    return c


def span_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes have equal hashes wherever they stand."""
    return mix((c[ends] - c[starts]) * powers(len(c), "down")[starts] + (ends - starts).astype(np.uint64))


def word_hash(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, run_bytes: int = RUN_BYTES) -> np.ndarray:
    """The span_hash of each word (spans in order, none inside another), with sums over about run_bytes bytes at a time."""
    if len(a) <= 2 * run_bytes:
        return span_hash(prefix_sums(a), starts, ends)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + run_bytes, "right")))
        if ends[j - 1] - lo <= 2 * run_bytes:
            out[i:j] = span_hash(prefix_sums(a[lo : ends[j - 1]]), starts[i:j] - lo, ends[i:j] - lo)
        else:
            out[i] = long_hash(a, int(lo), int(ends[i]), run_bytes)
            j = i + 1
        i = j
    return out


def long_hash(a: np.ndarray, lo: int, hi: int, run_bytes: int = RUN_BYTES) -> np.uint64:
    """The span_hash of one long span, summed piece by piece."""
    total, scale = 0, 1
    step = pow(_BASE, run_bytes, 1 << 64)
    for at in range(lo, hi, run_bytes):
        part = a[at : min(hi, at + run_bytes)]
        total += scale * int((_BYTE[part] * powers(len(part))).sum(dtype=np.uint64))
        scale = scale * step % (1 << 64)
    return mix(np.array([(total + hi - lo) % (1 << 64)], np.uint64))[0]


def counts(first: np.ndarray) -> np.ndarray:
    return np.diff(first)


def concat(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ... as one array."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
