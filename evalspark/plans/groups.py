"""Group-wise plan shapes that stay balanced when one group holds a large share of all rows.

A window over a hot group sorts that whole group in one task. These helpers avoid it: a first row per group is a
map-side combined aggregate, a top n is pruned before the shuffle, a full rank is computed by range partitions, and
per-group results return to the rows through a salted join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.columns import col
from evalspark.plans.lineage import cut_lineage

SALTS = 8
TOP_N_IN_WINDOW = 1000  # Spark prunes row_number() <= n map-side up to this n by default


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence, last: bool = False) -> DataFrame:
    """The row of each group with the smallest (or largest) order struct, by partial aggregation."""
    rest = [c for c in df.columns if c not in by]
    pick = F.max_by if last else F.min_by
    key = F.struct(*[col(o).alias(f"k{i}") for i, o in enumerate(order)])
    kept = df.groupBy(*by).agg(pick(F.struct(*rest), key).alias("__row"))
    return kept.select(*by, "__row.*").select(*df.columns)


def top_per_group(df: DataFrame, by: Sequence[str], n: int, order: Sequence) -> DataFrame:
    """The first n rows of each group."""
    order = [col(o) for o in order]
    if n <= TOP_N_IN_WINDOW:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")
    return rank_rows(df, by, order, "__rn").filter(F.col("__rn") <= n).drop("__rn")


def rank_rows(df: DataFrame, by: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    """row_number() per group with no group held by one task.

    Rows are range-partitioned on (group, order), so a hot group spans many partitions. The partition number is
    frozen by a checkpoint; each partition ranks its own rows, and a running count per (group, partition), at most one
    row per partition for each group, supplies the offset. The order must be total within a group.
    """
    by, order = list(by), [col(o) for o in order]
    placed = cut_lineage(df.repartitionByRange(*[F.col(b) for b in by], *order)
                         .withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    local = Window.partitionBy(*by, "__part").orderBy(*order)
    ranked = placed.withColumn("__local", F.row_number().over(local))
    return (ranked.join(starts, [*by, "__part"])
            .withColumn(name, (F.col("__start") + F.col("__local")).cast("bigint"))
            .drop("__start", "__local", "__part"))


def join_groups(df: DataFrame, groups: DataFrame, on: Sequence[str], how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Attach one row per group to every row of the group; the groups are repeated per salt so that a hot group is
    spread over several tasks. `groups` must be compact against `df`. Spark still turns it into a broadcast join when
    the measured size allows."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)).cast("int")
    salt = F.coalesce(salt, F.lit(0))
    right = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("__salt", salt).join(right, [*on, "__salt"], how).drop("__salt")


GATHER_ROWS = 100_000


def gather(df: DataFrame, on: Sequence[str], rows: int = GATHER_ROWS, like: DataFrame | None = None) -> DataFrame:
    """The rows of a key in one partition, in so many partitions that each has at most about `rows` rows, in full rounds of
    the cores. Spark would choose by the size of what it shuffles here, though these rows are repeated afterwards: groups of
    the repeats on the key and more are then found where the rows lie, in tables that a task can hold. Tables placed by the
    rows of the same table (`like`) meet in joins where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = math.ceil((df if like is None else like).count() / rows)
    return df.repartition(cores * max(1, math.ceil(n / cores)), *on)


def scalar(df: DataFrame, value: str) -> Column:
    """A one-row aggregate as a scalar subquery: no join, no driver round trip."""
    return df.select(value).scalar()


def running(df: DataFrame, by: Sequence[str], order: Sequence, values: dict[str, tuple]) -> DataFrame:
    """Running aggregates over the strictly earlier rows of each group, balanced like rank_rows.

    `values` maps an output column to (aggregate function, input column), for an aggregate that combines with itself
    (sum, max, min). The first row of a group gets NULL.
    """
    by, order = list(by), [col(o) for o in order]
    placed = cut_lineage(df.repartitionByRange(*[F.col(b) for b in by], *order)
                         .withColumn("__part", F.spark_partition_id()))
    local = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*by, "__part").agg(*[f(c).alias(f"__p_{o}") for o, (f, c) in values.items()])
    parts = parts.select(*by, "__part", *[f(f"__p_{o}").over(earlier).alias(f"__s_{o}") for o, (f, _) in values.items()])
    rows = placed.select("*", *[f(c).over(local).alias(f"__l_{o}") for o, (f, c) in values.items()])
    out = rows.join(parts, [*by, "__part"])
    merge = {F.sum: lambda a, b: F.coalesce(a + b, a, b), F.max: F.greatest, F.min: F.least}

    def combined(o: str, f) -> Column:
        a, b = F.col(f"__l_{o}"), F.col(f"__s_{o}")
        if f in merge and dict(out.dtypes)[f"__l_{o}"].startswith("struct"):
            pick = (a > b) if f is F.max else (a < b)
            return F.when(a.isNull(), b).when(b.isNull(), a).when(pick, a).otherwise(b)
        return merge[f](a, b)

    return out.select(*df.columns, *[combined(o, f).alias(o) for o, (f, _) in values.items()])


HOT_ROWS = 1_000_000


def join_skewed(df: DataFrame, groups: DataFrame, on: Sequence[str], size: str, how: str = "inner",
                limit: int = HOT_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """Attach one row per key when the keys are many and a few may be hot. `groups[size]` is the number of rows of
    each key in `df`: a key above `limit` is split into size / limit salts, and every other key joins as usual. The
    table of hot keys holds at most rows / limit entries; it is read from `sizes` where that (keys and `size`) is given,
    so that groups that are dear to make are made once."""
    on = list(on)
    n = F.ceil(F.col(size) / F.lit(float(limit))).cast("int")
    hot = (groups if sizes is None else sizes).filter(F.col(size) > limit).select(*on, n.alias("__salts"))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.coalesce("__salts", F.lit(1)).cast("bigint"))
    left = df.join(hot, on, "left").withColumn("__salt", F.coalesce(salt.cast("int"), F.lit(0))).drop("__salts")
    right = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))).drop(size)
    return left.join(right, [*on, "__salt"], how).drop("__salt")


BLOCK_ROWS = 10_000


def block_join(left: DataFrame, right: DataFrame, on: Sequence[str], limit: int = BLOCK_ROWS) -> DataFrame:
    """Inner equi-join of two sides that may both be crowded in one key. A key with more than `limit` rows on a side is cut
    into blocks of about that size, and each pair of blocks meets in a task of its own; other keys meet as usual. The
    table of crowded keys has at most rows / limit entries."""
    on = list(on)
    sides = [left.groupBy(*on).agg(F.count(F.lit(1)).alias("__l"), F.lit(0).cast("bigint").alias("__r")),
             right.groupBy(*on).agg(F.lit(0).cast("bigint").alias("__l"), F.count(F.lit(1)).alias("__r"))]
    n = sides[0].unionByName(sides[1]).groupBy(*on).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
    blocks = [F.ceil(F.col(c) / F.lit(float(limit))).cast("int").alias(c) for c in ("__l", "__r")]
    crowded = n.filter((F.least("__l", "__r") > 0) & (F.greatest("__l", "__r") > limit)).select(*on, *blocks)

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        mine, theirs = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        t = df.join(crowded, on, "left").withColumn(f"{own}b", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), mine.cast("bigint")).cast("int"))
        return t.withColumn(f"{other}b", F.explode(F.sequence(F.lit(0), theirs - 1))).drop("__l", "__r")

    return placed(left, "__l", "__r").join(placed(right, "__r", "__l"), [*on, "__lb", "__rb"]).drop("__lb", "__rb")
