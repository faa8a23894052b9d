"""Prefix trie of conversations from their sorted order: longest common prefixes of neighbours, a sparse table of range
minima over them, and one pair of binary searches per prefix for the interval of its members."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import join_by_size
from evalspark.plans.lineage import cut_lineage

DIGEST = 16
BLOCK_ROWS = 4096
BLOCK_BYTES = 32 << 20
ID_BLOCK = 1 << 14


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): per conversation the (digest, n_chars) of its turns in order. NULL role and text are empty; turns
    without a number come first and equal numbers go by digest. Rows without a conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    one = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"), digest.alias("digest"),
                            F.char_length(text).alias("n_chars")).alias("t"))
    return one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.transform("t", lambda t: F.struct(t.digest.alias("digest"), t.n_chars.alias("n_chars"))).alias("turns"))


def branched(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations rebuilt on their base: the first h turns of conversation c - c % every, then the own turns after the
    first h, with h = crc32(c) % most. A base serves fewer than 2 * every conversations."""
    h = F.crc32(F.col("conv_id").cast("string")) % most
    own = turns.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h.cast("int")})
    base = turns.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("first"))
    none = F.array().cast(dict(turns.dtypes)["turns"])
    head = F.coalesce(F.slice("first", F.lit(1), F.col("h")), none)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(base, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def sequences(conversations: DataFrame) -> DataFrame:
    """(seq, lengths, first_conv, copies): one row per distinct sequence of turns, so equal conversations meet once."""
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), ""))
    lengths = F.transform("turns", lambda t: t.n_chars.cast("bigint"))
    return conversations.select("conv_id", seq.alias("seq"), lengths.alias("lengths")).groupBy("seq").agg(
        F.first("lengths").alias("lengths"), F.min("conv_id").alias("first_conv"), F.count(F.lit(1)).alias("copies"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from their start."""
    n = min(len(a), len(b)) // DIGEST
    x = np.frombuffer(a, "V16", n) == np.frombuffer(b, "V16", n)
    return n if x.all() else int(np.argmin(x))


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minima of all runs of 2^k values."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def extents(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the members of each candidate prefix (row, depth). Row i shares levels[0][i] turns with row
    i - 1. Both searches halve their step, and ask the table for the minimum of the next 2^k rows."""
    n = len(levels[0])
    left, right = at.copy(), at.copy()
    for k in range(len(levels) - 1, -1, -1):
        step, table = 1 << k, levels[k]
        can = right + step < n
        ok = can & (table[np.where(can, right + 1, 0)] >= depth)
        right = np.where(ok, right + step, right)
        can = left - step >= 0
        ok = can & (table[np.where(can, left - step + 1, 0)] >= depth)
        left = np.where(ok, left - step, left)
    return left, right


def block_nodes(seqs: list[bytes], lengths: list[list[int]], convs: np.ndarray, copies: np.ndarray, before: int, after: int) -> dict:
    """Nodes of a run of sorted sequences. `before` and `after` are the turns that its first and last row share with their
    neighbours outside (-1: there is none). All values are sums or minima over members, so that a node whose interval
    goes on in another run is the sum of its parts."""
    n = len(seqs)
    size = np.array([len(s) // DIGEST for s in seqs], np.int64)
    lcp = np.array([before] + [common_turns(a, b) for a, b in zip(seqs, seqs[1:])], np.int64)
    inner = lcp.copy()
    inner[0] = -1  # the run starts here: no search goes further left
    following = np.append(lcp[1:], after)
    own = [np.concatenate(([0], np.cumsum(np.array(x, np.int64)))) for x in lengths]
    # the candidates: prefixes of a row that the row before it in this run does not have
    first = inner + 1
    count = size - first + 1
    at = np.repeat(np.arange(n), count)
    depth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    left, right = extents(sparse_table(inner), at, depth)
    smallest = sparse_table(convs)
    level = np.frexp((right - left + 1).astype(float))[1] - 1
    lowest = np.empty(len(at), np.int64)
    for k in range(len(smallest)):
        sel = level == k
        lowest[sel] = np.minimum(smallest[k][left[sel]], smallest[k][right[sel] - (1 << k) + 1])
    run = lambda x: np.concatenate(([0], np.cumsum(x)))
    over = lambda x: run(x)[right + 1] - run(x)[left]
    new_chars = np.array([c[-1] - c[max(p, 0)] for c, p in zip(own, lcp)], np.int64)
    above = np.array([own[i][max(d - 1, 0)] for i, d in zip(at, depth)], np.int64)
    known = np.array([own[i][max(p, 0)] for i, p in zip(at, lcp[at])], np.int64)
    truly = depth > lcp[at]  # the node does not go on to the left, outside of this run
    members = over(copies)
    # children: rows that leave their neighbour just at this depth, and the first row's own next turn
    order = np.sort(np.maximum(inner, 0) * (n + 1) + np.arange(n))
    leaving = np.searchsorted(order, depth * (n + 1) + right, "right") - np.searchsorted(order, depth * (n + 1) + left, "right")
    # the first row of the run may itself be a row that leaves at this depth
    edge = (left == 0) & ~truly & (lcp[0] == depth) & (size[0] > depth)
    digests = []
    for i in range(n):
        h, keys = hashlib.md5(), [hashlib.md5().digest()]
        for t in range(size[i]):
            h.update(seqs[i][t * DIGEST:(t + 1) * DIGEST])
            keys.append(h.copy().digest() if t + 1 >= first[i] - 1 else b"")
        digests.append(keys)
    whole = size[at] == depth
    return {"depth": depth, "key": [digests[i][d] for i, d in zip(at, depth)], "parent": [digests[i][d - 1] if d else None for i, d in zip(at, depth)],
            "conv_id": lowest, "n_convs": members, "n_children": leaving + (truly & (size[at] > depth)) + edge,
            "n_leaves": over((following < size).astype(np.int64)),
            "saved_tokens": over(copies * np.array([c[-1] for c in own], np.int64)) - members * above
            - over(new_chars) + np.where(truly, above - known, 0),
            "ends": [hashlib.md5(seqs[i]).digest() if w else None for i, w in zip(at, whole)]}


NODES = pa.schema([("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("n_convs", pa.int64()),
                   ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.binary())])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last sequence of every sorted partition."""
    run, first, last = None, None, None
    for batch in batches:
        if batch.num_rows:
            run = batch.column("run")[0].as_py()
            first = batch.column("seq")[0].as_py() if first is None else first
            last = batch.column("seq")[batch.num_rows - 1].as_py()
    if run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], ["run", "first", "last"])


def _seams(pdf_iter):
    for pdf in pdf_iter:
        yield pdf[["run"]].assign(before=[-1 if p is None else common_turns(bytes(p), bytes(f)) for p, f in zip(pdf["previous"], pdf["first"])],
                                  after=[-1 if f is None else common_turns(bytes(x), bytes(f)) for x, f in zip(pdf["last"], pdf["next"])])


def member_digests(conversations: DataFrame) -> DataFrame:
    """(seq, ends_sha256): SHA-256 of the decimal ids, ascending and comma-joined, of the conversations that are exactly
    this sequence. Ids are first joined in blocks of neighbouring ids, so that copies in their millions reach the task
    of their group as few strings, which are hashed one after another."""
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), ""))
    rows = conversations.select("conv_id", F.unhex(F.md5(seq)).alias("key"), F.floor(F.col("conv_id") / ID_BLOCK).alias("block"))
    blocks = rows.groupBy("key", "block").agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], ["key", "ends_sha256"])

    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(hashed, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie over (conv_id, turns), turns being an array of (digest as 32 hex letters, n_chars): conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Distinct sequences are range-partitioned and sorted. A partition is read in blocks of bounded rows and bytes; inside
    a block the sparse table answers every candidate, and a node that spans blocks is the sum of its parts, which meet by
    prefix digest. Only the lengths shared across partition edges are looked up beforehand, one row per partition. A
    conversation's digests (16 bytes a turn) are one row; equal conversations are one row with a count. No rows give no
    nodes; conversations without turns are members of the root alone.
    """
    convs = cut_lineage(conversations.select("conv_id", "turns"))
    ordered = sequences(convs).repartitionByRange("seq").sortWithinPartitions("seq")
    ordered = cut_lineage(ordered.withColumn("run", F.spark_partition_id()))
    edges = ordered.select("run", "seq").mapInArrow(_edges, "run int, first binary, last binary")
    seams = edges.selectExpr("run", "first", "last", "lag(last) OVER (ORDER BY run) AS previous", "lead(first) OVER (ORDER BY run) AS next").mapInPandas(
        _seams, "run int, before int, after int")
    # a row per partition of the job: numbers that a driver that plans the job holds anyway
    shared = ordered.sparkSession.sparkContext.broadcast({r.run: (r.before, r.after) for r in seams.toLocalIterator()})

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight, before = [], 0, None

        def flush(after: int) -> Iterator[pa.RecordBatch]:
            cols = list(zip(*rows))
            found = block_nodes(list(cols[0]), list(cols[1]), np.array(cols[2], np.int64), np.array(cols[3], np.int64), before, after)
            table = pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in NODES], schema=NODES)
            for i in range(0, table.num_rows, 10_000):
                yield table.slice(i, 10_000)

        run = None
        for batch in batches:
            run = batch.column("run")[0].as_py() if batch.num_rows else run
            for row in zip(*[batch.column(c).to_pylist() for c in ("seq", "lengths", "first_conv", "copies")]):
                if before is None:
                    before = shared.value[run][0]
                if len(rows) >= BLOCK_ROWS or weight > BLOCK_BYTES:
                    seam = common_turns(rows[-1][0], row[0])
                    yield from flush(seam)
                    rows, weight, before = [], 0, seam
                rows.append(row)
                weight += 3 * len(row[0])
        if rows:
            yield from flush(shared.value[run][1])

    kind = "depth bigint, key binary, parent binary, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends binary"
    parts = ordered.select("run", "seq", "lengths", "first_conv", "copies").mapInArrow(nodes, kind)
    total = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    trie = cut_lineage(parts.groupBy("depth", "key").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in total], F.max("ends").alias("ends")))
    parents = trie.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"),
                                                   F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = join_by_size(trie.filter("depth > 0"), parents, ["depth", "parent"], "n_children")
    every = below.unionByName(trie.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    digests = member_digests(convs).withColumnRenamed("key", "ends")
    return every.join(digests, "ends", "left").select(
        "conv_id", "depth", "parent_conv_id", *total, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
