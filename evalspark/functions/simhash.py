"""Simhash fingerprints of texts in normalised views: views by Spark functions, grams hashed and counted in Arrow batches.

A gram's 64-bit hash votes on 64 bits. Within a stretch of texts every distinct gram is hashed once, whatever the text or
view it stands in, and the votes of up to 255 grams are added eight bits at a time, as bytes of long integers. A text's
grams never leave its task: rows that move are fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.digests import md5_heads

SHINGLE_WORDS, GRAM_CHARS = 3, 5
BLOCK = 255  # grams whose votes a byte can count
STRETCH = 1 << 20  # letters whose grams are held at once
SPACE = " \t\r\n"
WORDS = re.compile(f"[^{SPACE}]+")
# the steps of normalisation; a view takes the steps before it as well
STEPS = ("as it is", "case", "line order", "white space", "punctuation")


def text_views(df: DataFrame, text: str, last: int) -> DataFrame:
    """Columns __v0 to __v`last`: the text as it is, then in lower case, with its lines sorted, with single blanks, without
    punctuation. Each step works on the column of the one before, so that none is computed twice."""
    steps = [lambda t: t, F.lower, lambda t: F.array_join(F.array_sort(F.split(t, "\n", -1)), "\n"),
             lambda t: F.trim(F.regexp_replace(t, f"[{SPACE}]+", " ")),
             lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N} ]", ""), " +", " "))]
    for i, step in enumerate(steps[:last + 1]):
        df = df.withColumn(f"__v{i}", step(F.col(f"__v{i - 1}" if i else text)))
    return df


def _bits(grams: bytes, sizes) -> np.ndarray:
    """A row per gram: the bits of the first 64 bits of its md5, highest first, as 64 bytes that fill eight longs."""
    return np.unpackbits(md5_heads(grams, sizes).astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)


def _joined(grams: Iterable[str]) -> tuple[bytes, list[int]]:
    """The grams one after the other in UTF-8, and their sizes."""
    grams = [g.encode() for g in grams]
    return b"".join(grams), list(map(len, grams))


def _add_votes(votes: np.ndarray, owner: np.ndarray, sizes: np.ndarray, index: np.ndarray, bits: np.ndarray, block: int) -> None:
    """Add to votes[owner[k]] the bits of the next sizes[k] grams, which index[] names."""
    owner, sizes = owner[sizes > 0], sizes[sizes > 0]
    if not len(sizes):
        return
    parts = -(-sizes // block)
    first = np.repeat(np.cumsum(sizes) - sizes, parts) + block * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    sums = np.empty((len(first), 8), np.uint64)
    for k in range(8):
        sums[:, k] = np.add.reduceat(np.ascontiguousarray(bits[:, k])[index], first)
    np.add.at(votes, np.repeat(owner, parts), sums.view(np.uint8).astype(np.int64))


def _codes(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the distinct values, and the values."""
    encoded = pa.array(index).dictionary_encode()
    return encoded.indices.to_numpy(), encoded.dictionary.to_numpy()


def char_votes(texts: list[str], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(votes, grams) of the runs of five characters of each text; a shorter text is one run, an empty one none."""
    votes, n = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    short = [i for i, t in enumerate(texts) if 0 < len(t) < GRAM_CHARS]
    if short:
        n[short] = 1
        _add_votes(votes, np.array(short), np.ones(len(short), np.int64), np.arange(len(short)), _bits(*_joined(texts[i] for i in short)), block)
    long = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t) - GRAM_CHARS + 1, STRETCH)]
    while long:
        size, taken = 0, 0
        while taken < len(long) and size < STRETCH:
            size += min(len(texts[long[taken][0]]) - long[taken][1], STRETCH)
            taken += 1
        pieces = [texts[i][at:at + STRETCH + GRAM_CHARS - 1] for i, at in long[:taken]]
        owner, long = np.array([i for i, _ in long[:taken]]), long[taken:]
        lengths = np.array([len(p) for p in pieces])
        letters = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        within = np.ones(len(letters), bool)
        within[(np.cumsum(lengths)[:, None] - np.arange(1, GRAM_CHARS)).ravel()] = False
        # a run is named by its letters' numbers in one long; of large alphabets, its first three letters get a number first
        there = np.zeros(0x110000, bool)
        there[letters] = True
        alphabet = np.flatnonzero(there)
        width = max(1, int(len(alphabet) - 1).bit_length())
        number = np.zeros(0x110000, np.uint64)
        number[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
        letters, within = number[letters], within[:len(letters) - GRAM_CHARS + 1]

        def joined(first: int, last: int, bits: int) -> np.ndarray:
            out = letters[first:first + len(within)].copy()
            for k in range(first + 1, last + 1):
                out <<= np.uint64(bits)
                out |= letters[k:k + len(within)]
            return out[within]

        if width * GRAM_CHARS <= 64:
            index, names = _codes(joined(0, GRAM_CHARS - 1, width))
            spelled = [names >> np.uint64(width * (GRAM_CHARS - 1 - k)) & np.uint64((1 << width) - 1) for k in range(GRAM_CHARS)]
        else:
            heads, head = _codes(joined(0, 2, 21))
            index, names = _codes(heads.astype(np.uint64) << np.uint64(42) | joined(3, 4, 21))
            low, front = np.uint64((1 << 21) - 1), head[names >> np.uint64(42)]
            spelled = [front >> np.uint64(42), front >> np.uint64(21) & low, front & low, names >> np.uint64(21) & low, names & low]
        runs = alphabet[np.stack(spelled, axis=1).astype(np.int64)].astype(np.uint32)
        in_utf8 = sum(((runs >= least).sum(axis=1) for least in (0x80, 0x800, 0x10000)), np.full(len(runs), GRAM_CHARS))
        bits = _bits(runs.tobytes().decode("utf-32-le").encode(), in_utf8)
        sizes = lengths - GRAM_CHARS + 1
        np.add.at(n, owner, sizes)
        _add_votes(votes, owner, sizes, index, bits, block)
    return votes, n


def word_votes(texts: list[str], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(votes, grams) of the runs of three words of each text; fewer words are one run, none give none."""
    votes, n = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    alike: dict[str, list[int]] = {}  # texts by their words: views often differ in white space alone
    for i, t in enumerate(texts):
        alike.setdefault(" ".join(WORDS.findall(t)), []).append(i)
    alike.pop("", None)
    sizes, grams = [], []

    def flush() -> None:
        if sizes:
            distinct = dict.fromkeys(grams)
            place = dict(zip(distinct, range(len(distinct))))
            index = np.fromiter(map(place.__getitem__, grams), np.int64, len(grams))
            _add_votes(votes, np.array([o for o, _ in sizes]), np.array([s for _, s in sizes]), index, _bits(*_joined(distinct)), block)
        sizes.clear()
        grams.clear()

    for text, same in alike.items():
        words = text.split(" ")
        for at in range(0, max(len(words) - SHINGLE_WORDS + 1, 1), STRETCH // 8):
            part = words[at:at + STRETCH // 8 + SHINGLE_WORDS - 1]
            runs = list(map(" ".join, zip(*[part[k:] for k in range(SHINGLE_WORDS)]))) if len(part) >= SHINGLE_WORDS else [" ".join(part)]
            grams.extend(runs)
            sizes.append((same[0], len(runs)))
            n[same[0]] += len(runs)
            if len(grams) >= STRETCH // 8:
                flush()
    flush()
    for same in alike.values():
        votes[same], n[same] = votes[same[0]], n[same[0]]
    return votes, n


def majority(votes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bits that more than half of the votes set, as signed longs."""
    return np.packbits(2 * votes > n[:, None], axis=1).view(">i8").ravel().astype(np.int64)


def text_fingerprints(df: DataFrame, keys: Sequence[str], text: str = "text", views: Sequence[str] = STEPS) -> DataFrame:
    """(keys, h1, h2), arrays over `views`: h1 from shingles of three words, h2 from runs of five characters, each gram
    voting as often as it occurs; a bit is set when more than half of the votes set it.

    One row per distinct (keys, text): rows that agree in both have one fingerprint. NULL text counts as empty, and a
    text without grams has the fingerprint 0. Texts are taken as UTF-8, STRETCH letters at a time.
    """
    keys = list(keys)
    at = [STEPS.index(v) for v in views]
    # a table may lie in one file of one row group, and the work on a text is far more than moving it
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__t")).repartition(parts).withColumn("__id", F.unhex(F.md5("__t")))
    seen = text_views(base, "__t", max(at)).select(*keys, "__id", F.array(*[F.col(f"__v{i}") for i in at]).alias("__views"))
    block = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for i, row in enumerate(batch.column("__views")):
                held.append(row.as_py())
                size += sum(map(len, held[-1]))
                if size >= STRETCH or i + 1 == batch.num_rows:
                    number = {t: k for k, t in enumerate(dict.fromkeys(t for r in held for t in r))}
                    where = np.array([[number[t] for t in r] for r in held])
                    prints = [majority(*f(list(number), block))[where] for f in (word_votes, char_votes)]
                    part = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(c) for c in (*keys, "__id")], *[pa.array(list(p), pa.list_(pa.int64())) for p in prints]], [*keys, "__id", "h1", "h2"])
                    first, held, size = i + 1, [], 0

    kinds = dict(seen.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in (*keys, "__id")) + "h1 array<bigint>, h2 array<bigint>"
    return seen.mapInArrow(run, schema).distinct().select(*keys, "h1", "h2")
