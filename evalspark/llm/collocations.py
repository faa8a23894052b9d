"""Collocations counted on a prefix-free parse: texts become overlapping chunks that end where their content says so, equal
chunks are kept once with their frequency, and phrases are counted inside distinct chunks, weighted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import join_by_size
from evalspark.plans.lineage import cut_lineage, stored

LONGEST = 5
OVERLAP = LONGEST - 1
EVERY = 32
BREAK = b"\xff"
# Letters that end a piece, and the lower case of A-Z.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
LETTERS = bytes.maketrans(PIECE_ENDS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t", BREAK * len(PIECE_ENDS) + b"abcdefghijklmnopqrstuvwxyz ")
SYMBOLS = 600_000
WORDS = 200_000
FILTER_BITS = (16, 26)


def symbols(text: bytes) -> list[bytes]:
    """Words and breaks between pieces, in order. 0xFF is no byte of UTF-8, so a break is no word."""
    return text.translate(LETTERS).replace(BREAK, b" \xff ").split()


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a sum of hashes counts."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n symbols, from the symbols' hashes."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        out = mixed(out + h[k:k + len(out)])
    return out


class Hashes(dict):
    """64-bit hash of a symbol."""

    def __missing__(self, s: bytes) -> int:
        h = self[s] = xxhash.xxh64_intdigest(s)
        return h


class Words:
    """Numbers of the words of all languages, from 1 in order of first use; 0 is a break."""

    class Table(dict):
        def __init__(self, all_: Words, lang: str):
            super().__init__({BREAK: 0})
            self.all, self.lang = all_, lang

        def __missing__(self, w: bytes) -> int:
            n = self[w] = len(self.all.words)
            self.all.words.append(w)
            self.all.langs.append(self.lang)
            self.all.hashes.append(xxhash.xxh64_intdigest(w) ^ self.all.seed[self.lang])
            return n

    def __init__(self):
        self.words, self.langs, self.hashes = [BREAK], [""], [0]
        self.tables: dict[str, Words.Table] = {}
        self.seed: dict[str, int] = Hashes()

    def numbers(self, lang: str, chunks: list[bytes]) -> np.ndarray:
        """Numbers of the symbols of all chunks, a break after each."""
        seed = self.seed[lang.encode("utf-8")]
        self.seed[lang] = seed
        table = self.tables.setdefault(lang, Words.Table(self, lang))
        return np.fromiter(map(table.__getitem__, b" \xff ".join([*chunks, BREAK])[:-2].split(b" ")), np.int32)


def parse(docs: DataFrame, lang: str = "lang", text: str = "text", every: int = EVERY) -> DataFrame:
    """(lang, own, chunk, freq): the dictionary of the parse. A chunk ends with a window of OVERLAP symbols whose hash is 0
    modulo `every`; the next chunk starts with the same window. `own` is the place of the first symbol that no chunk before
    it holds, so an n-gram of up to OVERLAP + 1 words belongs to just one chunk: that which owns its last word. A chunk's
    symbols are joined by blanks."""
    base = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter(F.col("text").isNotNull())

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        counts: dict[tuple[str, int, bytes], int] = {}
        weight = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(counts.items())
            for i in range(0, len(rows), 4096):
                some = rows[i:i + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k, _ in some], pa.string()), pa.array([k[1] for k, _ in some], pa.int32()),
                     pa.array([k[2] for k, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], ["lang", "own", "chunk", "freq"])

        for batch in batches:
            for language, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                s = symbols(t.encode("utf-8"))
                if not s:
                    continue
                if len(hashes) > WORDS:
                    hashes.clear()
                h = window_hash(np.fromiter(map(hashes.__getitem__, s), np.uint64), OVERLAP)
                ends = (np.flatnonzero(h % np.uint64(every) == 0) + OVERLAP).tolist()
                start, own = 0, 0
                for end in [*ends, len(s)]:
                    if end - start > own:
                        key = (language, own, b" ".join(s[start:end]))
                        counts[key] = counts.get(key, 0) + 1
                        weight += end - start
                        start, own = end - OVERLAP, OVERLAP
            if weight > 2 * SYMBOLS:
                yield from flush()
                counts, weight = {}, 0
        yield from flush()

    found = base.mapInArrow(chunks, "lang string, own int, chunk binary, freq bigint")
    return found.groupBy("lang", "own", "chunk").agg(F.sum("freq").alias("freq"))


def places(parsed_columns: tuple, known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol numbers of the chunks of a batch end to end, with a break after each, the frequency of their chunk, and
    whether they are the chunk's own."""
    langs, own, chunks, freq = parsed_columns
    lengths = np.array([c.count(b" ") + 2 for c in chunks])
    by_lang: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by_lang.setdefault(lang, []).append(i)
    out = []
    for lang, at in by_lang.items():
        n = lengths[at]
        ids = known.numbers(lang, [chunks[i] for i in at])
        start = np.repeat(np.cumsum(n) - n, n)
        out.append((ids, np.repeat(freq[at], n), np.arange(len(ids)) - start >= np.repeat(own[at], n)))
    return tuple(np.concatenate(x) for x in zip(*out))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
    """The places of all batches, SYMBOLS or more at a time."""
    known, held, size = Words(), [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(places((batch.column("lang").to_pylist(), batch.column("own").to_numpy(), batch.column("chunk").to_pylist(), batch.column("freq").to_numpy()), known))
        size += len(held[-1][0])
        if size > SYMBOLS:
            yield known, *(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
            if len(known.words) > WORDS:
                known = Words()
    if held:
        yield known, *(np.concatenate(x) for x in zip(*held))


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes before all second ones, so that the compression of a shuffle sees runs of zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def frequent_buckets(parsed: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(n_words, bucket) of the hash buckets in which words (1) or pairs (2) occur `least` times or more, and (lang, n), the
    words of every language.

    There are eight buckets or more for every place of the text. A task sends the buckets it met as sorted differences
    with counts, one value per range of buckets, which costs some two bytes a pair where the words themselves would cost
    twenty; what is rare is then known before a single phrase is spelled out.
    """
    size = parsed.count() * EVERY
    width = min(max(int(16 * size).bit_length(), 20), 62)
    high = min(max((size >> 19).bit_length(), 3), width - 3)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known, ids, weight, owned in blocks(batches):
            hashes, langs = np.array(known.hashes, np.uint64), known.langs
            rows: list[tuple] = []
            good = ids != 0
            for n in (1, 2):
                good = good[:len(ids) - n + 1] & (ids[n - 1:] != 0)
                at = np.flatnonzero(good & owned[n - 1:])
                if not len(at):
                    continue
                if n == 1:
                    total = np.bincount(ids[at], weight[at])
                    words = np.flatnonzero(total)
                    sums: dict[str, int] = {}
                    for lang, f in zip([langs[w] for w in words.tolist()], total[words].tolist()):
                        sums[lang] = sums.get(lang, 0) + int(f)
                    rows += [(0, 0, lang, None, None, f) for lang, f in sums.items()]
                bucket = (window_hash(hashes[ids], n)[at] & np.uint64((1 << width) - 1)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, new = bucket[order], weight[at][order]
                first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                count, bucket = np.add.reduceat(new, first), bucket[first]
                part = bucket >> (width - high)
                cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
                for lo, hi in zip(cuts, cuts[1:]):
                    rows.append((n, int(part[lo]), None, planes(np.diff(bucket[lo:hi], prepend=part[lo] << (width - high))), planes(count[lo:hi]), None))
            for i in range(0, len(rows), 2048):
                cols = list(zip(*rows[i:i + 2048]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64()))],
                                                 ["n_words", "part", "lang", "buckets", "counts", "n"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> pa.RecordBatch:
            bucket, count = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            many = bucket[first][np.add.reduceat(count[order], first) >= least]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(many), at[0], np.int32)), pa.array(many)], ["n_words", "bucket"])

        for batch in batches:
            for n, part, gaps, counts in zip(*[batch.column(c).to_pylist() for c in ("n_words", "part", "buckets", "counts")]):
                if (n, part) != at:
                    if held:
                        yield close()
                    at, held = (n, part), []
                held.append(((part << (width - high)) + np.cumsum(unplanes(gaps, np.int64)), unplanes(counts, np.int64)))
        if held:
            yield close()

    rows = parsed.select("lang", "own", "chunk", "freq").mapInArrow(met, "n_words int, part int, lang string, buckets binary, counts binary, n bigint")
    rows = rows.repartition("n_words", "part", "lang").sortWithinPartitions("n_words", "part")
    rows = stored(rows, "buckets")
    found = rows.filter("n_words > 0").select("n_words", "part", "buckets", "counts").mapInArrow(kept, "n_words int, bucket bigint")
    return stored(found, "frequent"), rows.filter("n_words = 0").groupBy("lang").agg(F.sum("n").alias("n"))


def filter_of(buckets: DataFrame) -> np.ndarray:
    """Bits of frequent buckets, 16 or more for each of them and at most 2^26 (8 MB) in all: a fuller filter lets more
    phrases be counted, and drops none."""
    n = buckets.count()
    width = min(max(int(16 * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    at = F.col("bucket").bitwiseAND(F.lit((1 << width) - 1)) + 1  # bitmaps count from 1
    rows = buckets.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = np.zeros((1 << width) // 8, np.uint8)
    for row in rows.toLocalIterator():  # at most 2,048 rows of 4 KB
        piece = np.frombuffer(bytes(row.bits), np.uint8)
        lo = (row.k - 1) * 4096
        bits[lo:lo + 4096] = piece[:max(0, min(4096, len(bits) - lo))]
    return bits


def test_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def ngram_counts(parsed: DataFrame, words: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """(lang, phrase, n_words, f) of all phrases of up to LONGEST words whose words and pairs may be in the filters."""
    shared = parsed.sparkSession.sparkContext.broadcast((words, pairs))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known, ids, weight, owned in blocks(batches):
            hashes = np.array(known.hashes, np.uint64)
            single = (ids != 0) & test_bits(shared.value[0], window_hash(hashes[ids], 1))
            double = test_bits(shared.value[1], window_hash(hashes[ids], 2)) & single[:-1] & single[1:]
            good, code = single, ids.astype(np.int64)
            for n in range(1, LONGEST + 1):
                length = len(ids) - n + 1
                if n == 2:
                    good = double
                elif n > 2:
                    good = good[:length] & double[n - 2:n - 2 + length]
                at = np.flatnonzero(good)
                if not len(at):
                    break
                if n == 1:
                    inverse, where = code[at], None
                else:  # runs of n symbols as (run of n - 1, symbol), numbered anew so that they fit one integer
                    _, where, inverse = np.unique((code[at] << 32) | ids[at + n - 1], return_index=True, return_inverse=True)
                    code = np.zeros(length, np.int64)
                    code[at] = inverse
                total = np.bincount(inverse, np.where(owned[at + n - 1], weight[at], 0))
                keep = np.flatnonzero(total)  # sums of whole numbers below 2^53 are exact in doubles
                for i in range(0, len(keep), 16_384):
                    some = keep[i:i + 16_384]
                    rows = some[:, None] if where is None else ids[at[where[some]][:, None] + np.arange(n)]
                    first = rows[:, 0].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([known.langs[x] for x in first], pa.string()),
                         pa.array([b" ".join([known.words[w] for w in r]) for r in rows.tolist()], pa.binary()),
                         pa.array(np.full(len(some), n, np.int32)), pa.array(total[some].astype(np.int64))], ["lang", "phrase", "n_words", "f"])

    rows = parsed.select("lang", "own", "chunk", "freq").mapInArrow(counted, "lang string, phrase binary, n_words int, f bigint")
    return rows.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "n_words").agg(F.sum("f").alias("f"))


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) in decimals of 38 digits; an overflow is an error, not a wrong number."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (wide(a) * wide(n)).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    below = wide(left) * wide(right)
    # the quotient of the division may be rounded up by its last digit: the remainder tells the true floor
    whole = F.floor(top / below).cast("decimal(38,0)")
    exact = F.when(whole * below > top, whole - 1).when((whole + 1) * below <= top, whole + 1).otherwise(whole)
    return F.coalesce(exact, F.raise_error(F.lit("a score passes 38 digits")).cast("decimal(38,0)")).cast("bigint")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, every: int = EVERY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to five words of every language.

    Texts are lower-cased in A-Z, split at `[.,;:!?\\x0A-\\x0D]` into pieces and at blanks and tabs into words. A phrase's
    score is the lowest floor(1000 a n / (l r)) over its cuts; a phrase that lies in a longer candidate of the same frequency
    goes. NULL lang is `und`, NULL and empty texts hold no words; no words give no rows. Ids are not read: repeated rows
    count as often as they occur. Other columns are not read.

    Only the distinct chunks of the parse are counted, first words and pairs by hash bucket, then phrases themselves: a
    phrase can reach `least` only if its words and pairs do, so one with a rarer part is passed over by a filter that has
    no false negatives.
    """
    parsed = stored(parse(docs, every=every), "parse")
    frequent, total = frequent_buckets(parsed, least)
    bits = [filter_of(frequent.filter(F.col("n_words") == n)) for n in (1, 2)]
    known = stored(ngram_counts(parsed, *bits).filter(F.col("f") >= least), "phrases")
    candidates = known.filter("n_words > 1")
    word = F.split("phrase", " ", -1)
    part = lambda start, n: F.array_join(F.slice(word, start, n), " ")
    # a phrase inside a longer one of the same frequency is also inside one that is longer by a word, of that frequency
    inner = F.array(F.struct(part(F.lit(1), F.col("n_words") - 1).alias("phrase")), F.struct(part(F.lit(2), F.col("n_words") - 1).alias("phrase")))
    held = candidates.filter("n_words > 2").select("lang", F.explode(inner).alias("p"), "f").select("lang", "p.phrase", "f").distinct()
    left = candidates.join(held, ["lang", "phrase", "f"], "left_anti")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select(
        "lang", "phrase", "f", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"))
    cuts = cut_lineage(cuts)
    for side, name in (("first", "l"), ("rest", "r")):
        uses = cuts.groupBy("lang", side).agg(F.count(F.lit(1)).alias("uses"))
        counts = cut_lineage(uses.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side]))
        cuts = join_by_size(cuts, counts, ["lang", side], "uses")
    cuts = join_by_size(cuts, cut_lineage(total.join(cuts.groupBy("lang").agg(F.count(F.lit(1)).alias("uses")), "lang")), ["lang"], "uses")
    scored = cuts.withColumn("score", score(F.col("f"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "f", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    flat = best.select("lang", "phrase", F.col("f").alias("a"), "b.l", "b.r", "n", "b.score")
    ranked = flat.selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS place").filter(F.col("place") <= top)
    return ranked.select("lang", F.col("place").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
