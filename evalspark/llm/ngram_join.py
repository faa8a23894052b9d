"""N-gram Jaccard join by vertical partitioning: the n-gram order is cut into fragments, overlaps are counted in each
fragment separately and summed per pair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import join_by_size, maybe_among, plain
from evalspark.llm.shingles import shingle_set
from evalspark.plans.components import connected_components
from evalspark.plans.groups import join_skewed
from evalspark.plans.lineage import cut_lineage, stored

BUCKET_BITS = 18
CHUNKS = 64
FRAGMENTS = 8
HUB_ROWS = 1000
BITMAP_BITS = 23
SKETCH_BITS = 1024


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def frequency_sketch(docs: DataFrame, words: int) -> np.ndarray:
    """How many n-grams of all documents fall into each of 2^BUCKET_BITS buckets. The size is fixed, whatever the
    input: each task adds up its documents, tasks are added up by chunk, and CHUNKS rows reach the driver. It only
    serves to put common n-grams last in the global order; any order gives the same result."""
    step = (1 << BUCKET_BITS) // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for t in batch.column("text"):
                np.add.at(total, _bucket(shingle_set(t.as_py(), words)), 1)
        yield _chunks({c: total[c * step:(c + 1) * step] for c in range(CHUNKS)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                sums[c] = sums.get(c, 0) + np.frombuffer(data, np.int64)
        yield _chunks(sums)

    def _chunks(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                          ["chunk", "counts"])

    schema = "chunk int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition(CHUNKS, "chunk").mapInArrow(add, schema).collect()
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in rows:
        total[r.chunk * step:(r.chunk + 1) * step] += np.frombuffer(r.counts, np.int64)
    return total


def _order(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The tokens from rare to common: the global order is by (bucket count, hash)."""
    return tokens[np.argsort(counts[_bucket(tokens)], kind="stable")]


def fragment_table(counts: np.ndarray, fragments: int = FRAGMENTS) -> np.ndarray:
    """The fragment of each bucket: consecutive stretches of the global order with equal numbers of n-grams."""
    by = np.argsort(counts, kind="stable")
    before = np.cumsum(counts[by]) - counts[by]
    out = np.empty(len(counts), np.int32)
    out[by] = np.minimum(before * fragments // max(1, counts.sum()), fragments - 1)
    return out


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Of each of SKETCH_BITS hash values, whether an odd number of the tokens has it, as 64-bit words. The sketches of two
    sets differ in no more bits than the sets in tokens, as tokens of both cancel out."""
    odd = np.bincount((tokens & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _signatures(docs: DataFrame, counts, words: int, percent: int, kind: str) -> DataFrame:
    """(doc_id, n, digest, typical, prefix, sketch): set size, digest of the set, how common its n-grams are, the rarest
    n-grams, of which any partner must hold one (a set of n shares at least ceil(percent * n / 100)), and its sketch."""
    least = -(-percent // (100 - percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, digest, typical, prefix, odd = [], [], [], [], []
                for t in part.column("text"):
                    s = shingle_set(t.as_py(), words)
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    typical.append(int(1000 * np.log2(1 + sizes[_bucket(s)]).mean()) if len(s) else 0)
                    prefix.append(_order(s, sizes)[:len(s) - (percent * len(s) + 99) // 100 + 1].view(np.int64) if len(s) >= least else [])
                    odd.append(sketch(s) if len(s) >= least else [])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                                  pa.array(typical, pa.int32()), pa.array(prefix, pa.list_(pa.int64())),
                                                  pa.array(odd, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "typical", "prefix", "sketch"])

    return docs.mapInArrow(run, f"doc_id {kind}, n bigint, digest binary, typical int, prefix array<bigint>, sketch array<bigint>")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Which of 2^BITMAP_BITS hash values occur among the ids: a filter of fixed size (1 MB) that lets a scan leave out
    most documents before it does any work; what it lets through by chance is dropped by the joins that follow."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP_BITS))
    rows = ids.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros((1 << BITMAP_BITS) + (1 << 15) * 2, bool)
    for r in rows:  # buckets count from 1, and position p of a bucket is bit p % 8 of byte p // 8
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        out[r.k * (1 << 15):r.k * (1 << 15) + len(bits)] = bits
    return out


def _segments(docs: DataFrame, ids: DataFrame, cuts, words: int, kind: str) -> DataFrame:
    """(doc_id, fragment, tokens) of the documents named, and of a few more: their sets, cut at the fragments."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP_BITS))
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = cuts.value, np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column("k").to_numpy() * (1 << 15) + batch.column("p").to_numpy()]))
            for i, t in zip(batch.column("doc_id"), batch.column("text")):
                s = shingle_set(t.as_py(), words)
                f = table[_bucket(s)]
                found = np.unique(f).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(found), i.type), pa.array(found, pa.int32()),
                                                  pa.array([s[f == x].view(np.int64) for x in found], pa.list_(pa.int64()))],
                                                 ["doc_id", "fragment", "tokens"])

    placed = docs.withColumns({"k": F.bitmap_bucket_number(at), "p": F.bitmap_bit_position(at)})
    return placed.mapInArrow(run, f"doc_id {kind}, fragment int, tokens array<bigint>")


def _possible(n1: Column, at1: Column, n2: Column, at2: Column, percent: int) -> Column:
    """Whether two sets can link by their sizes and by what can follow a common n-gram at these places of the order."""
    need = F.lit(percent) * (n1 + n2)
    most = F.least(n1 - at1, n2 - at2)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * most >= need)


def _bounded(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """(a, na, b, nb, most): the pairs with an upper bound of their overlap, from two sketches of fixed size. Sets whose
    sketches differ in h bits differ in at least h n-grams, so they share at most (na + nb - h) / 2."""
    pairs = stored(pairs, "pairs")
    degree = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("degree")), "degree")
    owners = heads.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")).join(degree, "a")
    both = join_skewed(pairs, owners, ["a"], "degree", limit=HUB_ROWS, sizes=degree).join(
        heads.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb")), "b")
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return stored(both.select("a", "na", "b", "nb", F.floor((F.col("na") + F.col("nb") - apart) / 2).alias("most")), "pairs")


def _may_link(percent: int) -> Column:
    return (100 + percent) * F.col("most") >= percent * (F.col("na") + F.col("nb"))


def _overlaps(pairs: DataFrame, docs: DataFrame, cuts, words: int, percent: int, kind: str) -> DataFrame:
    """(a, b, near, far) of the pairs (a, na, b, nb) that share an n-gram: whether they link, and their Jaccard distance.
    Overlaps are counted per fragment and summed per pair. A hub with very many pairs is repeated over salts."""
    pairs = cut_lineage(pairs)
    used = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    segments = cut_lineage(_segments(docs, used, cuts, words, kind))
    degree = cut_lineage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("degree")))
    owners = maybe_among(segments.withColumnsRenamed({"doc_id": "a", "tokens": "ta"}), degree, "a")  # few sets are a hub's, only those move twice
    hubs = owners.join(degree, "a").groupBy("a").agg(
        F.collect_list(F.struct("fragment", "ta")).alias("segs"), F.max("degree").alias("degree"))
    one = join_skewed(pairs, hubs, ["a"], "degree", limit=HUB_ROWS, sizes=degree)
    one = one.select("a", "na", "b", "nb", F.inline("segs"))
    both = one.join(segments.withColumnsRenamed({"doc_id": "b", "tokens": "tb"}), ["b", "fragment"])
    partial = both.select("a", "na", "b", "nb", "fragment", F.size(F.array_intersect("ta", "tb")).cast("bigint").alias("common"))
    once = partial.groupBy("a", "na", "b", "nb", "fragment").agg(F.max("common").alias("common"))  # a repeated row counts nothing again
    total = once.groupBy("a", "na", "b", "nb").agg(F.sum("common").alias("common"))
    size = F.col("na") + F.col("nb")
    return total.select("a", "b", ((100 + percent) * F.col("common") >= percent * size).alias("near"),
                        (1.0 - F.col("common") / (size - F.col("common"))).alias("far"))


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, n_links, component_id), one row per document.

    Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of `words`-grams (lower-cased A-Z, split
    at ASCII white space; a shorter text is one n-gram). class_id is the smallest id with the same set, component_id the
    smallest id reachable by links, n_links the links found between the classes. Exact but for 64-bit hashes.

    Equal sets are one class first, so copies never pair up. Each class is listed under its rarest n-grams (prefix
    filter; n-grams found everywhere come last in the order). The classes of a list are compared with one hub each, the
    class whose n-grams are the most common, that is, the one nearest to the middle of a family of near copies; after
    that each member of a list that did not link to its hub is compared with the others. Two members that link to the hub
    are in one component already, so a family costs as many comparisons as it has members, not pairs; and as the Jaccard
    distance is a metric, two members whose distances to the hub differ by more than the bound need no comparison.
    Before two sets meet, sketches of SKETCH_BITS bits bound their overlap from above; pairs that cannot reach the
    threshold go no further, so the sets that move are nearly all of pairs that link.
    Comparisons ship sets cut at FRAGMENTS fragments of the global order; each fragment counts its part of the overlap
    and the parts are summed per pair.

    Documents without words (NULL, empty) have 0 n-grams and link with nothing: they are their own component. Repeated
    rows of one id with equal text give one row each; ids must not be NULL (such rows are left out) and name one text.
    Other columns are not read.
    """
    base = plain(docs, doc_id=id_col, text=text_col).filter("doc_id is not null")
    kind = dict(base.dtypes)["doc_id"]
    context = docs.sparkSession.sparkContext
    sketch = frequency_sketch(base, words)
    counts, cuts = context.broadcast(sketch), context.broadcast(fragment_table(sketch))
    rows = cut_lineage(_signatures(base, counts, words, percent, kind))
    classes = cut_lineage(rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members")))
    heads = cut_lineage(rows.filter("size(prefix) > 0").join(classes.select("digest", F.col("class_id").alias("doc_id")), ["digest", "doc_id"])
                        .select("doc_id", F.col("n").alias("nb"), "typical", "prefix", "sketch").dropDuplicates(["doc_id"]))
    listed = heads.select(F.col("doc_id").alias("b"), F.posexplode("prefix").alias("at", "token"))
    lists = cut_lineage(listed.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    shared = join_by_size(listed, lists, ["token"], "size").join(heads.select(F.col("doc_id").alias("b"), "nb", "typical"), "b")
    shared = cut_lineage(shared.select("token", "b", "nb", "at", "typical"))
    hubs = cut_lineage(shared.groupBy("token").agg(F.max_by(F.struct("b", "nb", "at"), F.struct("typical", "b")).alias("hub"),
                                                   F.count(F.lit(1)).alias("size")))
    shared = join_by_size(shared.drop("typical"), hubs, ["token"], "size").select(
        "token", "b", "nb", "at", F.col("hub.b").alias("a"), F.col("hub.nb").alias("na"), F.col("hub.at").alias("a_at"))
    shared = cut_lineage(shared.filter("a <> b"))
    first = _bounded(shared.filter(_possible(F.col("nb"), F.col("at"), F.col("na"), F.col("a_at"), percent))
                     .select("a", "na", "b", "nb").distinct(), heads)
    counted = _overlaps(first.filter(_may_link(percent)).drop("most"), base, cuts, words, percent, kind)
    least_far = 1.0 - F.col("most") / (F.col("na") + F.col("nb") - F.col("most"))  # of pairs that cannot link only this is known
    compared = stored(first.join(counted, ["a", "b"], "left").select(
        "a", "b", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("far", least_far).alias("far"), F.col("far").isNotNull().alias("exact")), "pairs")
    links = compared.filter("near").select("a", "b")

    placed = cut_lineage(shared.join(compared, ["a", "b"], "left").select("token", "b", "nb", "at", F.coalesce("near", F.lit(False)).alias("near"), "far", "exact"))
    out = placed.filter("not near").select("token", *[F.col(c).alias(f"o_{c}") for c in ("b", "nb", "at", "far", "exact")])
    bound = F.lit(1.0 - percent / 100 + 1e-9)
    apart = (F.col("exact") & (F.col("o_far") - F.col("far") > bound)) | (F.col("o_exact") & (F.col("far") - F.col("o_far") > bound))
    crossing = out.join(placed, "token").filter((F.col("b") != F.col("o_b")) & (F.col("near") | (F.col("b") < F.col("o_b")))
                                                & ~F.coalesce(apart, F.lit(False))
                                                & _possible(F.col("nb"), F.col("at"), F.col("o_nb"), F.col("o_at"), percent))
    second = crossing.select(F.greatest("b", "o_b").alias("a"), F.when(F.col("b") > F.col("o_b"), F.col("nb")).otherwise(F.col("o_nb")).alias("na"),
                             F.least("b", "o_b").alias("b"), F.when(F.col("b") > F.col("o_b"), F.col("o_nb")).otherwise(F.col("nb")).alias("nb")).distinct()
    known = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    second = _bounded(second.join(known, ["a", "b"], "left_anti").select("a", "na", "b", "nb"), heads).filter(_may_link(percent)).drop("most")
    links = stored(links.unionByName(_overlaps(second, base, cuts, words, percent, kind).filter("near").select("a", "b")), "links")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    linked = connected_components(ends.select("node"), links, out="component_id").join(ends, "node")
    final = cut_lineage(classes.join(linked.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "digest", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"), "members"))
    kept = join_by_size(rows.filter("n > 0").select("doc_id", "n", "digest"), final, ["digest"], "members")
    kept = kept.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "n_links", "component_id")
    return kept.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"),
                                                        F.lit(0).cast("bigint").alias("n_links"), F.col("doc_id").alias("component_id")))
