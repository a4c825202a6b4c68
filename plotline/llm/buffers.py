"""Texts as byte buffers: whole Arrow string columns at once, no per-row Python.

Hashes are polynomial fingerprints modulo 2**64 over a fixed random table, mixed at
the end. They depend on the bytes alone, so every task and every retry agrees.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15
_SPREAD = U(0xBF58476D1CE4E5B9)


def worker_cache() -> types.ModuleType:
    """What one Python worker keeps from task to task (functions travel by value, globals do not last)."""
    return sys.modules.setdefault("plotline_worker_cache", types.ModuleType("plotline_worker_cache"))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * _SPREAD
    return h ^ (h >> U(29))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)),
                                            pa.py_buffer(np.ascontiguousarray(data)))


def blocks(batches, column: str = "text", most: int = BLOCK_BYTES):
    """Record batches cut so that each holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def byte_table(keep) -> np.ndarray:
    """A 256-entry mask from a rule on the byte value."""
    return np.array([bool(keep(b)) for b in range(256)])


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def spans(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray):
    """Runs of kept bytes inside texts: starts, ends and the row each lies in."""
    inside = keep[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    have = getattr(cache, "powers", None)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        up = np.full(size, BASE, U)
        up[0] = 1
        down = np.full(size, pow(BASE, -1, 1 << 64), U)
        down[0] = 1
        have = cache.powers = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return have


def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the fingerprint of any span follows."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(byte_codes()[data] * up[:len(data)], dtype=U, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of spans; equal bytes give equal values wherever they stand."""
    _, down = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])
