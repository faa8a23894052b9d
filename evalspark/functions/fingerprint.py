"""Perceptual fingerprints of small grey grids, Arrow-batched: one matrix product per view."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

SIDE = 8


def resize_matrix(n: int, m: int) -> np.ndarray:
    """Linear map of n samples to m by the triangle filter on sample centres."""
    scale = max(n / m, 1.0)
    centre = (np.arange(m) + 0.5) * n / m
    w = np.maximum(0.0, 1.0 - np.abs((np.arange(n) + 0.5)[None, :] - centre[:, None]) / scale)
    return w / w.sum(axis=1, keepdims=True)


def dct_matrix(n: int, rows: int) -> np.ndarray:
    """First rows of the orthonormal DCT-II of length n."""
    u, x = np.arange(rows)[:, None], np.arange(n)[None, :]
    return np.where(u == 0, np.sqrt(1.0 / n), np.sqrt(2.0 / n)) * np.cos(np.pi * (2 * x + 1) * u / (2 * n))


LOW_FREQUENCY = dct_matrix(32, SIDE) @ resize_matrix(SIDE, 32)
GRADIENT = resize_matrix(SIDE, SIDE + 1)


def view_index() -> list[np.ndarray]:
    """Flat source positions in the eight symmetries of a square: rows and columns each counted from either end, and then
    exchanged or not. The first is the grid as it is."""
    ends = [np.arange(SIDE), np.arange(SIDE)[::-1]]
    places = [np.add.outer(SIDE * rows, columns) for rows in ends for columns in ends]
    return [p.ravel() for p in places] + [p.ravel("F") for p in places]


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def both_hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low-frequency hash (above the median, the constant term last) and horizontal gradient hash of [n, 64] grids."""
    g = x.reshape(len(x), SIDE, SIDE)
    freq = (LOW_FREQUENCY @ g @ LOW_FREQUENCY.T).reshape(len(x), -1)
    h1 = np.roll(freq, -1, axis=1) > np.median(freq[:, 1:], axis=1, keepdims=True)
    wide = g @ GRADIENT.T
    h2 = (wide[:, :, 1:] > wide[:, :, :-1]).reshape(len(x), -1)
    return _pack(h1), _pack(h2)


@F.pandas_udf(StructType().add("h1", ArrayType(LongType())).add("h2", ArrayType(LongType())))
def grid_fingerprints(grid: pd.Series) -> pd.DataFrame:
    x = np.asarray(grid.tolist(), dtype=np.float64).reshape(-1, SIDE * SIDE)
    pairs = [both_hashes(x[:, v]) for v in view_index()]
    return pd.DataFrame({"h1": list(np.stack([p[0] for p in pairs], axis=1)),
                         "h2": list(np.stack([p[1] for p in pairs], axis=1))})
