"""The first 64 bits of the md5 of many short messages at once, for Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np

ONE_BLOCK = 55  # longest message that md5 pads to a single block
CHUNK = 8192
SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
PLACES = [(1, 0), (5, 1), (3, 5), (7, 0)]
SINES = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _one_block(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the md5 of padded messages, one a column."""
    a, b, c, d = (np.full(words.shape[1], x) for x in START)
    for i in range(64):
        r = i // 16
        if r == 0:
            f = d ^ (b & (c ^ d))
        elif r == 1:
            f = c ^ (d & (b ^ c))
        elif r == 2:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        f += SINES[i]
        f += words[(PLACES[r][0] * i + PLACES[r][1]) % 16]
        by = SHIFTS[r][i % 4]
        low = f >> np.uint32(32 - by)
        f <<= np.uint32(by)
        f |= low
        f += b
        a, d, c, b = d, c, b, f
    return a + START[0], b + START[1]


def md5_heads(data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The first 64 bits of the md5 of each message, as unsigned longs; the messages lie one after the other in `data`."""
    sizes = np.asarray(sizes, np.int64)
    raw, ends = np.frombuffer(data, np.uint8), np.cumsum(sizes)
    out = np.empty(len(sizes), np.uint64)
    for at in range(0, len(sizes), CHUNK):
        size, end = sizes[at:at + CHUNK], ends[at:at + CHUNK]
        base, short = end[0] - size[0], np.minimum(size, ONE_BLOCK)
        block = np.zeros((len(size), 64), np.uint8)
        inside = np.arange(64) < short[:, None]
        here = raw[base:end[-1]]
        if (size > ONE_BLOCK).any():  # the bytes of longer messages are left out here
            here = here[np.arange(len(here)) - np.repeat(end - size - base, size) < ONE_BLOCK]
        block[inside] = here
        block[np.arange(len(size)), short] = 0x80
        block.view("<u8")[:, 7] = short * 8
        a, b = _one_block(np.ascontiguousarray(block.view("<u4").T))
        out[at:at + CHUNK] = a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()
    for i in np.flatnonzero(sizes > ONE_BLOCK).tolist():
        out[i] = int.from_bytes(hashlib.md5(data[ends[i] - sizes[i]:ends[i]]).digest()[:8], "big")
    return out
