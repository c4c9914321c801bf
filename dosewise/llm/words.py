"""Vectorised words, word hashes and word n-grams of Arrow text columns.

Words are ``[^\\x20\\x09-\\x0D]+``.  All functions work on a run of rows at a
time (``runs``), whose bytes are one numpy array; nothing loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; one longer text is a run of its own.
RUN_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_GRAM = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1024), np.uint64)
        have[1:] = np.uint64(base)
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that sums of hashes spread over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] per span; equal contents at any place hash alike."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_BASE_INV, n + 1)[starts] + (ends - starts).astype(np.uint64) * _GRAM[63])


@dataclass
class Run:
    """Rows ``first``..``first + n`` of a batch: their bytes, row offsets into them, and their words."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of row i: bounds[i]:bounds[i + 1]

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @property
    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.bounds))

    def hashes(self, salt: int = 0) -> np.ndarray:
        """64-bit hash of each word; another ``salt`` gives another hash function."""
        return span_hashes((mix(_BYTE + np.uint64(salt)) if salt else _BYTE)[self.data], self.starts, self.ends)

    def texts(self, index: np.ndarray) -> pa.StringArray:
        """The words of these numbers."""
        lengths = self.ends[index] - self.starts[index]
        ends = np.cumsum(lengths)
        at = np.arange(int(lengths.sum())) + np.repeat(self.starts[index] - (ends - lengths), lengths)
        offsets = np.append(0, ends).astype(np.int32)
        return pa.StringArray.from_buffers(len(index), pa.py_buffer(offsets), pa.py_buffer(self.data[at]))


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each of the consecutive spans given by ``bounds``."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def grams(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within one row, and the index of each one's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = hashes[:n] * _GRAM[0]
    for j in range(1, k):
        out += hashes[j:j + n] * _GRAM[j]
    at = np.flatnonzero(rows[:n] == rows[k - 1:])
    return mix(out[at]), at


def heads(hashes: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """By length, the hash of so many words from each word on; past a row's end the values mean nothing."""
    total, out = np.zeros(len(hashes), np.uint64), {}
    for j in range(max(lengths)):
        total[:max(len(hashes) - j, 0)] += hashes[j:] * _GRAM[j]
        if j + 1 in lengths:
            out[j + 1] = mix(total + np.uint64(j + 1))
    return out


def runs(column: pa.Array, lower: bool = False, run_bytes: int = RUN_BYTES, gaps: np.ndarray = _SPACE) -> Iterator[Run]:
    """Cut a string column (null: empty) into runs of about ``run_bytes``; words lie between the bytes of ``gaps``."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + run_bytes, "right")) - 1)
        last = min(last, len(column))
        own = data[offsets[first]:offsets[last]]
        yield cut(first, _LOWER[own] if lower else own, offsets[first:last + 1] - offsets[first], gaps)
        first = last


def cut(first: int, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> Run:
    n = len(data)
    gap = gaps[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens, closes = ~gap, ~gap
    opens[1:] &= gap[:-1] | edge[1:n]
    closes[:-1] &= gap[1:] | edge[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Run(first, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """Values cut at ``bounds`` as an Arrow list column; uint64 is reinterpreted as long."""
    if values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
