"""Removal of byte strings that occur twice anywhere: suffixes sorted deep-shallow within anchor groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import join_by_size, maybe_among, plain
from evalspark.llm.shingles import BYTES, mix
from evalspark.plans.lineage import cut_lineage, work_folder

GRAM = 32
PIECE = 1 << 18
SHALLOW = 32
BATCH_BYTES = 1 << 20
HOT_CONTEXTS = 512
BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def substring_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of each substring of `length` bytes, equal for equal substrings wherever they stand."""
    size = 1 << max(12, (len(data) + 1).bit_length())
    up, down = _TABLES.setdefault(size, (_powers(BASE, size), _powers(INVERSE, size)))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * up[:len(data)], out=total[1:])
        return mix((total[length:] - total[:-length]) * down[:len(total) - length])


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every `width` successive values, by running bests within blocks from both sides."""
    n = len(values) - width + 1
    fill = -len(values) % width
    x = np.concatenate([values, np.full(fill, values[-1], values.dtype)]).reshape(-1, width)
    ahead = best.accumulate(x, axis=1).ravel()
    behind = best.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first start, anchor of each window, gram hashes), piece by piece. The anchor of a window of `span` bytes is the
    smallest hash of the GRAM-byte strings in it, so equal windows have equal anchors."""
    for at in range(0, len(data) - span + 1, PIECE):
        grams = substring_hashes(data[at:at + PIECE + span - 1], GRAM)
        yield at, sliding(grams, span - GRAM + 1, np.minimum), grams


def anchor_counts(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a text, and for each whether its string stands once (1) or oftener (2) where it is the anchor."""
    found = []
    for at, least, grams in anchors(data, span):
        width = span - GRAM + 1
        edge = np.zeros(width - 1, np.uint64)
        found.append(grams[grams == sliding(np.concatenate([edge, least, edge]), width, np.maximum)])
    value, n = np.unique(np.concatenate(found), return_counts=True)
    return value, np.minimum(n, 2)


def candidate_runs(data: np.ndarray, span: int, wanted: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, number of windows, anchor) of the runs of successive windows with one anchor that is among the wanted."""
    for at, least, _ in anchors(data, span):
        cut = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        size = np.diff(np.concatenate((cut, [len(least)])))
        for k in np.flatnonzero(np.isin(least[cut], wanted)).tolist():
            yield at + int(cut[k]), int(size[k]), int(least[cut[k]].view(np.int64))


def _regroup(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort by the keys (last is first): the order, the number of each row's new group, and whether the group has more
    than one row."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    group = np.cumsum(new) - 1
    return order, group, np.bincount(group)[group] > 1


def repeated_windows(contexts: list[bytes], groups: list[int], span: int) -> list[np.ndarray]:
    """For each context, which of its windows of `span` bytes equal another window of a context of the same group.

    Deep-shallow sorting of all windows as suffixes: a multikey quicksort by words of eight bytes orders them to the
    shallow depth; windows that still tie go to blind tries. A trie keeps its first suffix whole and, for all others,
    only how far they agree with it and the byte that follows; those that agree in part fall into one subtrie per
    (depth, byte), and so on until every subtrie has one suffix. All tries of a batch are built level by level."""
    text = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    word = np.zeros(len(text) - 7, np.uint64)
    for k in range(8):
        word |= text[k:len(text) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    sizes = np.array([len(c) - span + 1 for c in contexts])
    first = np.cumsum([0, *map(len, contexts)])[:-1]
    owner = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = first[owner] + offset
    twice = np.zeros(len(owner), bool)
    row, group = np.arange(len(owner)), np.array(groups)[owner]
    for depth in range(0, SHALLOW, 8):
        order, number, tied = _regroup((word[place[row] + depth], group))
        row, group = row[order][tied], number[tied]
    while len(row):
        head = np.concatenate(([True], group[1:] != group[:-1]))
        lead = row[head][np.cumsum(head) - 1]
        agree = np.full(len(row), span)
        open_rows = np.flatnonzero(~head)
        for depth in range(SHALLOW, span, 8):
            a, b = word[place[row[open_rows]] + depth], word[place[lead[open_rows]] + depth]
            parted = np.flatnonzero(a != b)
            if len(parted):
                same = 7 - np.floor(np.log2((a ^ b)[parted].astype(np.float64))).astype(np.int64) // 8
                agree[open_rows[parted]] = np.minimum(span, depth + np.maximum(0, same))
                open_rows = open_rows[a == b]
        equal = (agree >= span) & ~head
        twice[row[equal]] = True
        twice[lead[equal]] = True
        rest = agree < span
        row, group, agree = row[rest], group[rest], agree[rest]
        order, number, tied = _regroup((text[place[row] + agree], agree, group))
        row, group = row[order][tied], number[tied]
    return np.split(twice, np.cumsum(sizes)[:-1])


def _spans(flags: np.ndarray) -> list[int]:
    """Starts and ends of the stretches of true flags, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])))).tolist()


def _sorted_groups(rows: DataFrame, span: int) -> DataFrame:
    """(c1, c2, spans) of the distinct contexts: their windows that stand twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, last, held = [], None, 0

        def out() -> Iterator[pa.RecordBatch]:
            if waiting:
                flags = repeated_windows([w[1] for w in waiting], [w[0] for w in waiting], span)
                spans = [[0, len(f)] if w[2] > 1 else _spans(f) for w, f in zip(waiting, flags)]
                yield pa.RecordBatch.from_arrays([pa.array([w[3] for w in waiting], pa.int64()), pa.array([w[4] for w in waiting], pa.int64()),
                                                  pa.array(spans, pa.list_(pa.int32()))], ["c1", "c2", "spans"])
                waiting.clear()

        for batch in batches:
            for w in zip(*[batch.column(c).to_pylist() for c in ("anchor", "context", "m", "c1", "c2")]):
                if w[0] != last and held > BATCH_BYTES:
                    yield from out()
                    held = 0
                last = w[0]
                waiting.append(w)
                held += len(w[1])
        yield from out()

    return rows.select("anchor", "context", "m", "c1", "c2").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        run, "c1 bigint, c2 bigint, spans array<int>")


def _hot_windows(rows: DataFrame, span: int) -> DataFrame:
    """The same for anchors with very many distinct contexts: their windows are spread by two hashes of each window, and
    those that stand once are seen as such without the contexts meeting."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for context, c1, c2, m in zip(*[batch.column(c).to_pylist() for c in ("context", "c1", "c2", "m")]):
                data = np.frombuffer(context, np.uint8)
                a, b = substring_hashes(data, span), substring_hashes(data ^ np.uint8(0xA5), span)
                n = len(a)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(n, c1)), pa.array(np.full(n, c2)),
                                                  pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, m))], ["a", "b", "c1", "c2", "at", "m"])

    windows = cut_lineage(rows.select("context", "c1", "c2", "m").mapInArrow(run, "a bigint, b bigint, c1 bigint, c2 bigint, at int, m bigint"))
    twice = cut_lineage(windows.groupBy("a", "b").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("size")).filter("n > 1"))
    found = join_by_size(windows, twice, ["a", "b"], "size")
    return found.groupBy("c1", "c2").agg(F.flatten(F.sort_array(F.collect_list(F.array("at", F.col("at") + 1)))).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row per input row: the text as UTF-8 bytes without
    every byte that a string of `span` bytes covers which starts anywhere else too, in the same or another document.

    Equal windows of `span` bytes share an anchor (their smallest GRAM-byte hash), so anchors that stand once rule out
    their windows at the first scan. Runs of windows with a repeated anchor are cut out with the bytes they cover; equal
    cuts collapse with their number before they move, so a passage with a third of all rows is one row per task. The
    cuts of an anchor meet in one task, where their windows are sorted as suffixes: a multikey quicksort to a shallow
    depth, then blind tries. Anchors with more than HOT_CONTEXTS distinct cuts, as at the edges of a passage found
    everywhere, are spread by window hashes instead. No step holds a document's windows against another document.

    `span` must be a multiple of 8, and at least 2 * GRAM. NULL counts as empty; shorter texts lose nothing. Rows that
    agree in id and text are one document delivered again: they do not repeat each other, and each gets the answer. Rows
    that agree in the id alone are documents of their own, each with its own spans. NULL is an id like another. Texts of
    any length are taken in pieces. Other columns are not read.
    """
    if span % 8 or span < 2 * GRAM:
        raise ValueError("span must be a multiple of 8 and at least 64")
    spark = docs.sparkSession
    base = plain(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = dict(base.dtypes)["doc_id"]
    tagged = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("~"))
    base = base.withColumn("key", F.unhex(F.md5(F.concat(tagged, F.lit(":"), F.md5("text")))))  # names an id and a text, is never NULL
    long = base.filter(F.octet_length("text") >= span)
    again = cut_lineage(long.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    if not again.isEmpty():  # only texts that may be there again move
        long = maybe_among(long, again, "key", negate=True).unionByName(maybe_among(long, again, "key").dropDuplicates(["key"]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column("key"), batch.column("text")):
                value, n = anchor_counts(np.frombuffer(t.as_py().encode(), np.uint8), span)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(value), i.type), pa.array(value.view(np.int64)), pa.array(n, pa.int32())],
                                                 ["key", "anchor", "n"])

    seen = cut_lineage(long.select("key", "text").mapInArrow(count, "key binary, anchor bigint, n int"))
    shared = cut_lineage(seen.groupBy("anchor").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("size")).filter("n > 1").drop("n"))
    wanted = cut_lineage(join_by_size(seen, shared, ["anchor"], "size").groupBy("key").agg(F.collect_list("anchor").alias("wanted")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, w in zip(batch.column("key"), batch.column("text"), batch.column("wanted")):
                raw = t.as_py().encode()
                runs = list(candidate_runs(np.frombuffer(raw, np.uint8), span, w.values.to_numpy().view(np.uint64)))
                cuts = [raw[s:s + n + span - 1] for s, n, _ in runs]
                marks = np.array([np.frombuffer(hashlib.blake2b(c, digest_size=16).digest(), np.int64) for c in cuts]).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(runs), i.type), pa.array([r[0] for r in runs], pa.int64()),
                                                  pa.array([r[2] for r in runs], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]),
                                                  pa.array(cuts, pa.binary())], ["key", "start", "anchor", "c1", "c2", "context"])

    path = work_folder(spark, "cuts")
    some = maybe_among(long, wanted.select("key"), "key").join(wanted, "key")
    some.select("key", "text", "wanted").mapInArrow(cut, "key binary, start bigint, anchor bigint, c1 bigint, c2 bigint, context binary").write.parquet(path)
    cuts = spark.read.parquet(path)
    distinct = cuts.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("m"))
    sizes = cut_lineage(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("m").alias("size")))
    hot = sizes.filter(F.col("kinds") > HOT_CONTEXTS).select("anchor")

    def once(rows: DataFrame) -> DataFrame:
        return rows.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("m"), F.first("context").alias("context"))

    # either way is right for any anchor, so those that pass the filter by chance may take the second
    found = _sorted_groups(once(maybe_among(cuts, hot, "anchor", negate=True)), span).unionByName(
        _hot_windows(once(maybe_among(cuts, hot, "anchor")), span))
    found = cut_lineage(found.filter(F.size("spans") > 0))
    places = cut_lineage(cuts.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("size")).join(found, ["c1", "c2"]))
    spans = cut_lineage(join_by_size(cuts.select("key", "start", "c1", "c2"), places, ["c1", "c2"], "size")
                        .groupBy("key").agg(F.collect_list(F.struct("start", "spans")).alias("found")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, f in zip(batch.column("text"), batch.column("found")):
                raw = t.as_py().encode()
                gone = np.zeros(len(raw) + 1, np.int32)
                for at in f.as_py() or []:
                    s = np.array(at["spans"], np.int64).reshape(-1, 2) + at["start"]
                    np.add.at(gone, s[:, 0], 1)
                    np.add.at(gone, s[:, 1] - 1 + span, -1)
                covered = np.cumsum(gone[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~covered].tobytes() if covered.any() else raw
                out.append((len(raw), int(covered.sum()), len(_spans(covered)) // 2, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    hit = maybe_among(base, spans.select("key"), "key").join(spans, "key", "left")
    clean = maybe_among(base, spans.select("key"), "key", negate=True)
    whole = F.encode("text", "utf-8")
    return hit.select("doc_id", "text", "found").mapInArrow(keep, schema).unionByName(
        clean.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
                     F.lit(0).cast("bigint").alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"), whole.alias("kept")))
