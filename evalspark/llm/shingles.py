"""Hashes of word n-grams of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SPAN = 1 << 12


def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(SPAN, 0x9E3779B97F4A7C15 | 1, np.uint64))


POWERS = _powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the published splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word (A-Z lower-cased, split at ASCII white space) in order: a polynomial over byte hashes."""
    data = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    letter = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False]))))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        owner = np.cumsum(letter & np.concatenate(([True], ~letter[:-1]))) - 1
        place = np.arange(len(data)) - start[np.maximum(owner, 0)]
        terms = np.where(letter, BYTES[data] * POWERS[place % SPAN], np.uint64(0))
        return mix(np.add.reduceat(terms, start) + (stop - start).astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of all runs of `words` words, sorted; of a shorter text the whole sequence as one; none for a
    text without words."""
    h = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(h):
        return h
    span = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - span + 1, span, np.uint64)
        for k in range(span):
            out = mix(out + h[k:len(h) - span + 1 + k])
    return np.unique(out)
