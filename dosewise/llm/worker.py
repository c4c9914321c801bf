"""What a Python worker holds between its tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa


def _trim() -> None:
    """Give the freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches a task makes; after the last one its freed memory is given back, as the worker lives on beside later stages."""
    yield from batches
    _trim()
