"""Many 64-bit keys in a binary value: what tasks send each other by ranges of the keys costs some 6 bytes a key, and no row."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa

U64 = np.uint64


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences, which mostly fit into 6 bytes; the first byte says how many."""
    steps = np.diff(keys, prepend=U64(0))
    width = 6 if not len(steps) or int(steps.max()) < 1 << 48 else 8
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :width] = raw
    return np.cumsum(steps.view("<u8").ravel(), dtype=U64)


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte each, or 255 and the count itself at the end."""
    counts = counts.astype(np.int64)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpacked_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


def ranges(keys: np.ndarray, n: int) -> tuple[list[int], list[slice]]:
    """The numbers of those of n equal ranges that have some of the ascending keys, and their places."""
    bounds = np.searchsorted((keys >> U64(32)) * U64(n) >> U64(32), np.arange(n + 1, dtype=U64))
    some = np.flatnonzero(bounds[1:] > bounds[:-1]).tolist()
    return some, [slice(bounds[i], bounds[i + 1]) for i in some]


def packed_owners(owners: np.ndarray) -> bytes:
    """Numbers that repeat: the distinct ones and the place of each."""
    distinct, at = np.unique(owners, return_inverse=True)
    width = 2 if len(distinct) <= 1 << 16 else 4
    return len(distinct).to_bytes(4, "little") + bytes([width]) + distinct.astype("<i8").tobytes() + at.astype(f"<u{width}").tobytes()


def unpacked_owners(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    return np.frombuffer(data, "<i8", n, 5)[np.frombuffer(data, f"<u{width}", offset=5 + 8 * n)]


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows that come sorted, by their first `keys` columns."""
    rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True))
    return groupby(rows, key=lambda r: r[:keys])
