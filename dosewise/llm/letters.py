"""Character n-grams of letter sequences, vectorised over runs of texts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

import numpy as np

from .words import _GRAM, mix

RUN_CHARS = 250_000
_POINTS = 0x110000


@cache
def _fold() -> np.ndarray:
    """Per code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(_POINTS, np.uint32)
    for c in range(0xD800):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    for c in range(0xE000, _POINTS):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def runs(texts: Iterable):
    """(first row, folded code points, row of each) of about RUN_CHARS characters; everything but letters becomes one 0 between words."""
    first, own, size = 0, [], 0
    for text in texts:
        own.append(text or "")
        size += len(own[-1])
        if size >= RUN_CHARS:
            yield first, *_run(own)
            first, own, size = first + len(own), [], 0
    if own:
        yield first, *_run(own)


def _run(texts: list[str]):
    # a 0 before each text and after the last one, so words have a border on both sides
    points = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    row = np.append(row, len(texts) - 1)
    folded = _fold()[points]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 0) | (folded[:-1] != 0) | (row[1:] != row[:-1])
    return folded[keep], row[keep], len(texts)


def grams(folded: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every n-gram that lies within one text and holds a letter (borders count as a character)."""
    size = len(folded) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    wide = folded.astype(np.uint64)
    out = wide[:size] * _GRAM[0]
    letters = folded[:size] != 0
    for j in range(1, n):
        out += wide[j:j + size] * _GRAM[j]
        letters |= folded[j:j + size] != 0
    # the text's last word ends at the next text's leading border, which counts as its own
    ok = letters & ((row[:size] == row[n - 1:]) | ((row[:size] == row[n - 2:len(row) - 1]) & (folded[n - 1:] == 0)))
    return mix(out[ok] + np.uint64(n)), row[:size][ok]
