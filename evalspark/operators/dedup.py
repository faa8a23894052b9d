"""Duplicates and leakage between sources, pair evidence, grouping of related items."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import hamming, ratio
from evalspark.functions.fingerprint import grid_fingerprints
from evalspark.plans.components import connected_components  # noqa: F401  (part of this module's surface)
from evalspark.plans.groups import block_join, join_groups, join_skewed, rank_rows
from evalspark.plans.lineage import cut_lineage

H1_MAX, H2_MAX = 6, 10
BLOCK = 20_000


# --- exact ---

def exact_key(df: DataFrame, content: str, out: str = "key") -> DataFrame:
    return df.withColumn(out, F.md5(F.col(content).cast("binary")))


def exact_overlap(df: DataFrame, key: str = "key", source: str = "source") -> DataFrame:
    """Distinct shared keys of every pair of sources. Copies collapse to one row per (source, key) first; a key then
    holds at most one row per source."""
    d = df.select(source, key).distinct()
    srcs = d.groupBy(key).agg(F.sort_array(F.collect_set(source)).alias("s")).filter(F.size("s") > 1)
    left = srcs.select("s", F.posexplode("s").alias("i", "source_a"))
    pairs = left.select("source_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("source_b"))
    return pairs.groupBy("source_a", "source_b").agg(F.count(F.lit(1)).alias("exact_duplicates"))


# --- fingerprints ---

def fingerprints(df: DataFrame, grid: str = "grid") -> DataFrame:
    """Both 64-bit fingerprints of every grid in its eight views (view 0 is the grid itself)."""
    rest = [c for c in df.columns if c != grid]
    return df.withColumn("__f", grid_fingerprints(grid)).select(*rest, "__f.h1", "__f.h2")


def band_scheme(n: int) -> int:
    """More bands (longer band-set keys) for more fingerprints, so that a key keeps few of them."""
    return 8 if n <= 1_000_000 else 10 if n <= 100_000_000 else 12


def _band_keys(h, bands: int, spare: int):
    """Keys of every set of `bands - spare` bands: two hashes within distance `spare` agree on at least one set."""
    edges = [round(i * 64 / bands) for i in range(bands + 1)]
    masks = [sum(1 << bit for bit in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [m - 2**64 if m >= 2**63 else m for m in masks]
    sets = list(combinations(range(bands), bands - spare))

    def union(s) -> int:
        m = sum(masks[i] & (2**64 - 1) for i in s) & (2**64 - 1)
        return m - 2**64 if m >= 2**63 else m

    return masks, [(i, union(s), s) for i, s in enumerate(sets)]


def near_pairs(df: DataFrame, d1: int = H1_MAX, bands: int | None = None, source: str = "source") -> DataFrame:
    """Pairs of distinct fingerprints of different sources (query source first, in its eight views; the other in view
    0) whose smallest h1 distance is at most d1, with multiplicities.

    Items with equal fingerprints collapse first. Exact by the pigeonhole principle: the bands are joined on every set
    of bands - d1 equal bands, and a pair is emitted only for its first matching set.
    """
    f = df.groupBy(source, "h1", "h2").agg(F.count(F.lit(1)).alias("m"))
    f = f.withColumn("fid", F.unhex(F.md5(F.to_json(F.struct(source, "h1", "h2")))))
    bands = band_scheme(f.count()) if bands is None else bands
    masks, sets = _band_keys(None, bands, d1)
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("mask"), F.lit(sum(1 << b for b in s)).alias("bits"),
                               F.lit((1 << (max(s) + 1)) - 1).alias("upto")) for i, m, s in sets])
    q = f.select(F.col(source).alias("source_a"), F.col("fid").alias("qa"), F.explode("h1").alias("x")).distinct()
    q = q.withColumn("t", F.explode(table))
    r = f.select(F.col(source).alias("source_b"), F.col("fid").alias("rb"), F.col("h1")[0].alias("z"))
    r = r.withColumn("t", F.explode(table))
    q = q.select("source_a", "qa", "x", F.col("t.i").alias("i"), F.col("t.bits").alias("bits"),
                 F.col("t.upto").alias("upto"), F.col("x").bitwiseAND(F.col("t.mask")).alias("key"))
    r = r.select("source_b", "rb", "z", F.col("t.i").alias("i"), F.col("z").bitwiseAND(F.col("t.mask")).alias("key"))
    j = q.join(r, ["i", "key"]).filter("source_a < source_b")
    diff = F.col("x").bitwiseXOR(F.col("z"))
    equal = sum(((diff.bitwiseAND(F.lit(m)) == 0).cast("int") * (1 << b) for b, m in enumerate(masks)), F.lit(0))
    j = j.filter(hamming("x", "z") <= d1).filter(equal.bitwiseAND(F.col("upto")) == F.col("bits"))
    pairs = j.groupBy("source_a", "source_b", "qa", "rb").agg(F.min(hamming("x", "z")).alias("d1"))
    a = f.select(F.col("fid").alias("qa"), F.col("h2").alias("qh2"), F.col("m").alias("ma"))
    b = f.select(F.col("fid").alias("rb"), F.col("h2")[0].alias("rh2"), F.col("m").alias("mb"))
    full = pairs.join(a, "qa").join(b, "rb")
    d2 = F.array_min(F.transform("qh2", lambda v: F.bit_count(v.bitwiseXOR(F.col("rh2")))))
    return full.select("source_a", "source_b", "qa", "rb", "d1", d2.alias("d2"), (F.col("ma") * F.col("mb")).alias("pairs"))


def near_duplicates(df: DataFrame, d1: int = H1_MAX, d2: int = H2_MAX, bands: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Near-duplicate pairs per source pair: both smallest distances small, each over its own best view."""
    return (near_pairs(df, d1, bands) if pairs is None else pairs).filter(F.col("d2") <= d2).groupBy("source_a", "source_b").agg(
        F.sum("pairs").alias("near_duplicates"))


def _block_min(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if not len(left) or not len(right):
        return pd.DataFrame({"source_a": pd.Series(dtype=object), "source_b": pd.Series(dtype=object), "d": pd.Series(dtype="int32")})
    q = np.concatenate(left["h1"].to_list()).astype(np.int64).view(np.uint64)
    r = right["z"].to_numpy(dtype=np.int64).view(np.uint64)
    best = min(int(np.bitwise_count(q[s:s + 512, None] ^ r[None, :]).min()) for s in range(0, len(q), 512))
    return pd.DataFrame({"source_a": [left["source_a"].iloc[0]], "source_b": [left["source_b"].iloc[0]], "d": [best]})


def min_distance(df: DataFrame, source: str = "source", block: int = BLOCK, pairs: DataFrame | None = None) -> DataFrame:
    """Smallest h1 distance of every pair of sources, query in its eight views.

    Pairs of sources with a near hit are answered by the band join. The others need every distance: both sides are cut
    into blocks of bounded size, each pair of blocks meets in one task, and a task returns its minimum only.
    """
    f = df.select(source, "h1").distinct()
    hit = (near_pairs(df) if pairs is None else pairs).groupBy("source_a", "source_b").agg(F.min("d1").alias("min_distance"))
    n = f.groupBy(source).agg(F.ceil(F.count(F.lit(1)) / float(block)).cast("int").alias("k"))
    every = n.agg(F.sort_array(F.collect_list(F.struct(source, "k"))).alias("s"))  # one entry per source
    left = every.select("s", F.posexplode("s").alias("i", "a"))
    todo = left.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")).select(
        F.col(f"a.{source}").alias("source_a"), F.col("a.k").alias("ka"), F.col(f"b.{source}").alias("source_b"), F.col("b.k").alias("kb"))
    todo = todo.join(hit, ["source_a", "source_b"], "left_anti")
    own = F.pmod(F.xxhash64("h1"), F.col("k")).cast("int")
    fb = join_groups(f, n, [source]).withColumn("own", own)
    q = fb.select(F.col(source).alias("source_a"), "h1", F.col("own").alias("i")).join(todo, "source_a").withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("kb") - 1))).select("source_a", "source_b", "i", "j", "h1")
    r = fb.select(F.col(source).alias("source_b"), F.col("h1")[0].alias("z"), F.col("own").alias("j")).join(
        todo, "source_b").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ka") - 1))).select(
        "source_a", "source_b", "i", "j", "z").distinct()
    keys = ["source_a", "source_b", "i", "j"]
    far = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(_block_min, "source_a string, source_b string, d int")
    rest = far.groupBy("source_a", "source_b").agg(F.min("d").alias("min_distance"))
    return hit.unionByName(rest)


def leak_audit(df: DataFrame, unreliable: Sequence[str] = (), source: str = "source") -> DataFrame:
    """One row per pair of sources: sizes, exact and near duplicates, smallest distance, a note for two sources whose
    fingerprints are known to be dominated by their format."""
    sizes = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    pairs = cut_lineage(near_pairs(df, source=source))
    near = near_duplicates(df, pairs=pairs)
    t = min_distance(df, source, pairs=pairs)
    for side in ("a", "b"):
        t = t.join(sizes.select(F.col(source).alias(f"source_{side}"), F.col("n").alias(f"n_{side}")), f"source_{side}")
    keys = ["source_a", "source_b"]
    t = t.join(exact_overlap(df), keys, "left").join(near, keys, "left")
    bad = F.col("source_a").isin(*unreliable) & F.col("source_b").isin(*unreliable) if unreliable else F.lit(False)
    return t.select(*keys, "n_a", "n_b", F.coalesce("exact_duplicates", F.lit(0)).alias("exact_duplicates"),
                    F.coalesce("near_duplicates", F.lit(0)).alias("near_duplicates"), "min_distance",
                    F.when(bad, "format dominates the hash").otherwise("").alias("note"))


# --- pair evidence from local features ---

def feature_sets(codes: DataFrame, by: str = "cls", item: str = "item_id", code: str = "code") -> tuple[DataFrame, DataFrame]:
    """(contents, members): items with equal feature counts share a content whose id is the smallest item; contents are
    (cls, content, n, norm) with their features, members map every item to its content."""
    c = codes.groupBy(by, item, code).agg(F.count(F.lit(1)).alias("w"))
    # two independent 64-bit sums identify the counts of an item whatever their order, without gathering them
    sums = [F.sum(h.cast("decimal(38,0)")) for h in (F.xxhash64(code, "w"), F.xxhash64("w", code, F.lit(17)))]
    own = c.groupBy(by, item).agg(F.concat_ws(":", *[x.cast("string") for x in sums]).alias("digest"),
                                  F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("w")).alias("norm"))
    content = own.groupBy(by, "digest").agg(F.min(item).alias("content"), F.count(F.lit(1)).alias("copies"))
    members = own.join(content, [by, "digest"]).select(by, item, "content", "copies", "n", "norm")
    feats = c.join(members.filter(F.col(item) == F.col("content")).select(by, item, "n", "norm", "copies"), [by, item])
    return feats.withColumnRenamed(item, "content").withColumnRenamed(code, "code").withColumnRenamed(by, "cls"), \
        members.withColumnRenamed(by, "cls")


def pairs_within(feats: DataFrame, min_matches: int, min_overlap: float) -> DataFrame:
    """Candidate pairs a < b of one class that can share `min_matches` features and `min_overlap` of the larger set.

    Prefix filter: with features ordered from rare to common, a qualifying pair must share a feature among the first
    n - required + 1 of each side, so common features are hardly ever joined on. Positional filter: at their first
    shared feature, enough must follow on both sides. A feature held by very many items is joined in blocks.
    """
    freq = feats.groupBy("cls", "code").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    need = F.greatest(F.lit(min_matches), F.ceil(F.col("n") * F.lit(min_overlap) - 1e-9)).cast("int")
    d = feats.join(freq, ["cls", "code"]).select("cls", "content", "n", need.alias("need"), F.struct("df", "code").alias("f"))
    # features seen once cannot be shared; they come first in the order and take up prefix places
    shared = d.groupBy("cls", "content").agg(F.count(F.lit(1)).alias("shared"))
    d = join_skewed(d.select("*", "f.df", "f.code").drop("f"), shared.withColumn("m", F.col("shared")), ["cls", "content"], "m")
    pre = rank_rows(d.filter("shared >= need"), ["cls", "content"], ["df", "code"], "r").filter("r <= shared - need + 1")
    rest = F.col("shared") - F.col("r") + 1
    a, b = (pre.select("cls", "code", F.col("content").alias(x), F.col("n").alias(f"n{x}"), rest.alias(f"rest_{x}"), F.col("need").alias(f"need_{x}"))
            for x in ("a", "b"))
    fits = (F.least("na", "nb") >= F.lit(min_overlap) * F.greatest("na", "nb") - 1e-9) & (F.col("a") < F.col("b"))
    fits = fits & (F.least("rest_a", "rest_b") >= F.greatest("need_a", "need_b"))
    return block_join(a, b, ["cls", "code"]).filter(fits).select("cls", "a", "b").distinct()


def pair_evidence(feats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shared features, their share of the larger set, and the cosine of the counts of every candidate pair."""
    f = feats.select("cls", "content", "code", "w", "n", "norm", "copies")
    a = f.select("cls", F.col("content").alias("a"), "code", F.col("w").alias("wa"), F.col("n").alias("na"),
                 F.col("norm").alias("norm_a"), F.col("copies").alias("copies_a"))
    b = f.select("cls", F.col("content").alias("b"), "code", F.col("w").alias("wb"), F.col("n").alias("nb"),
                 F.col("norm").alias("norm_b"), F.col("copies").alias("copies_b"))
    j = pairs.join(a, ["cls", "a"]).join(b, ["cls", "b", "code"])
    t = j.groupBy("cls", "a", "b").agg(
        F.count(F.lit(1)).alias("matches"), F.sum(F.col("wa") * F.col("wb")).alias("dot"),
        *[F.max(c).alias(c) for c in ("na", "nb", "norm_a", "norm_b", "copies_a", "copies_b")])
    return t.select("cls", "a", "b", "copies_a", "copies_b", "matches", ratio("matches", F.greatest("na", "nb")).alias("overlap"),
                    (F.col("dot") / F.sqrt(F.col("norm_a").cast("double") * F.col("norm_b"))).alias("similarity"))


def accepted_pairs(codes: DataFrame, min_matches: int, min_overlap: float, min_similarity: float, **kw) -> DataFrame:
    feats, _ = feature_sets(codes, **kw)
    e = pair_evidence(feats, pairs_within(feats, min_matches, min_overlap))
    return e.filter((F.col("matches") >= min_matches) & (F.col("overlap") >= min_overlap)
                    & (F.col("similarity") > min_similarity))


def overlap_groups(codes: DataFrame, min_matches: int, min_overlap: float, min_similarity: float) -> DataFrame:
    """Group id (smallest item) of every item: components of the accepted pairs; copies of one content hang on it by a
    single edge each."""
    _, members = feature_sets(codes)
    edges = accepted_pairs(codes, min_matches, min_overlap, min_similarity).select("a", "b")
    same = members.filter((F.col("n") >= min_matches) & (F.col("content") != F.col("item_id"))).select(
        F.col("content").alias("a"), F.col("item_id").alias("b"))
    return connected_components(members.select("cls", "item_id"), edges.unionByName(same), "item_id", out="group_id")


# --- groups as units ---

def group_report(df: DataFrame, group: str = "group_id", label: str = "y") -> DataFrame:
    """Groups, groups with repeats, items in them, the largest group, then items and groups per class."""
    per = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy(group).agg(F.sum("n").alias("n"))
    total = g.agg(F.lit("all").alias("part"), F.sum("n").alias("items"), F.count(F.lit(1)).alias("groups"),
                  F.count(F.when(F.col("n") > 1, 1)).alias("repeated_groups"),
                  F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("items_in_repeats"),
                  F.max("n").alias("largest"))
    cls = per.groupBy(F.col(label).cast("string").alias("part")).agg(
        F.sum("n").alias("items"), F.count(F.lit(1)).alias("groups"),
        F.count(F.when(F.col("n") > 1, 1)).alias("repeated_groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("items_in_repeats"),
        F.max("n").alias("largest"))
    return total.unionByName(cls)


def mixed_groups(df: DataFrame, group: str = "group_id", label: str = "y") -> DataFrame:
    """Groups that hold more than one label."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("items"), F.countDistinct(label).alias("labels")).filter("labels > 1")


def assert_unmixed(df: DataFrame, group: str = "group_id", label: str = "y") -> DataFrame:
    n = mixed_groups(df, group, label).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return df.withColumn(group, F.when(n > 0, F.raise_error(F.lit("a group mixes labels")).cast(
        df.schema[group].dataType)).otherwise(F.col(group)))


def attach_units(df: DataFrame, unit_map: DataFrame, strict: bool = False, item: str = "item_id") -> DataFrame:
    """Class-prefixed unit of every item; an unmapped item is its own `solo_` unit, or an error when strict."""
    m = unit_map.select(item, F.concat_ws("_", "class_name", F.col("group_id").cast("string")).alias("__unit"))
    solo = F.concat(F.lit("solo_"), F.col(item).cast("string"))
    other = F.raise_error(F.concat(F.lit("no group for "), F.col(item).cast("string"))).cast("string") if strict else solo
    return df.join(m, item, "left").withColumn("unit", F.when(F.col("__unit").isNotNull(), F.col("__unit")).otherwise(other)) \
        .drop("__unit")


def contiguous_blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int, out: str = "block") -> DataFrame:
    """k contiguous blocks per group in the given order; the first n mod k blocks get one row more."""
    by = list(by)
    r = rank_rows(df, by, order, "__r")
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    i, q, rem = F.col("__r") - 1, F.floor(F.col("__n") / k), F.col("__n") % k
    big = rem * (q + 1)
    block = F.when(i < big, F.floor(i / (q + 1))).otherwise(rem + F.floor((i - big) / F.greatest(q, F.lit(1))))
    return join_groups(r, n, by).withColumn(out, block.cast("bigint")).drop("__r", "__n")
