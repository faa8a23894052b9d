"""Greedy suppression: walk a group in priority order and drop every row that conflicts with an earlier kept row.

The result depends on the order, so no plain join gives it. Groups up to FOLD_ROWS are walked in sorted partitions. A
larger group is never gathered: it is solved in rounds over a grid. In a round, a row whose priority is the
smallest among all cells it could conflict in is kept for certain, and the undecided rows near it are tested against
it. A cell has at most one winner per round, so a round stays linear in the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.plans.groups import join_groups
from evalspark.plans.lineage import cut_lineage, stored

FOLD_ROWS = 5000


def suppress(df: DataFrame, by: Sequence[str], order: Sequence, conflict: Callable[[str, str], Column],
             clashes: Callable[[np.ndarray, np.ndarray], bool], able: Column, register: Column, probe: Column,
             geometry: Sequence[str], fold_rows: int = FOLD_ROWS) -> DataFrame:
    """df with a boolean `kept`.

    order     columns that order a group totally
    conflict  expression for (earlier row, later row), each given as a column prefix such as "k." or "u."
    clashes   the same test for the walk: (geometry of the kept rows, geometry of one row)
    able      rows with a geometry that can conflict at all, and does with its equal; the others (empty, NULL, NaN or
              infinite geometry) are kept and drop nothing, in groups of every size
    register  array of bigint cells a row occupies; probe: the cells in which a conflicting earlier row is registered
    """
    by = list(by)
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    marked = stored(df.withColumn("__able", F.coalesce(able, F.lit(False))), "marked")
    apart = marked.filter(~F.col("__able")).drop("__able").withColumn("kept", F.lit(True))
    df = marked.filter("__able").drop("__able")
    hot = df.groupBy(*by).count().filter(F.col("count") > fold_rows).select(*by)
    if hot.isEmpty():
        return _walk(df, by, keys, clashes, geometry).unionByName(apart)
    prio = df.withColumn("__prio", F.struct(*[k.alias(f"o{i}") for i, k in enumerate(keys)]))
    large = _rounds(prio.join(hot, by, "left_semi"), by, conflict, register, probe, geometry).drop("__prio")
    return _walk(df.join(hot, by, "left_anti"), by, keys, clashes, geometry).unionByName(large).unionByName(apart)


def real(*columns: str) -> Column:
    """All of these numbers are there and finite."""
    inside = [F.abs(F.col(c)) < F.lit(float("inf")) for c in columns]  # NaN counts as larger than any number
    return reduce(lambda a, b: a & b, inside)


def _walk(df: DataFrame, by: list[str], keys: list[Column], clashes, geometry: Sequence[str]) -> DataFrame:
    """Groups side by side in sorted partitions; only the kept rows of the current group are remembered."""
    geometry = list(geometry)
    schema = df.withColumn("kept", F.lit(True)).schema

    def run(batches):
        current, kept, n = None, np.empty((64, len(geometry))), 0
        for pdf in batches:
            flags = np.zeros(len(pdf), dtype=bool)
            group = list(zip(*[pdf[b] for b in by])) if by else [()] * len(pdf)
            for i, row in enumerate(pdf[geometry].to_numpy(dtype=float)):
                if group[i] != current:
                    current, n = group[i], 0
                if n == 0 or not clashes(kept[:n], row):
                    if n == len(kept):
                        kept = np.concatenate([kept, np.empty_like(kept)])
                    kept[n], n, flags[i] = row, n + 1, True
            yield pdf.assign(kept=flags)

    placed = df.repartition(*[F.col(b) for b in by]).sortWithinPartitions(*by, *keys)
    return placed.mapInPandas(run, schema)


def _cells(d: DataFrame, by: list[str], cells: Column) -> DataFrame:
    return d.withColumn("__c", F.explode(cells)).withColumn("__cell", F.xxhash64(*by, "__c")).drop("__c")


def _rounds(df: DataFrame, by: list[str], conflict, register: Column, probe: Column, geometry: Sequence[str]) -> DataFrame:
    # equal geometry conflicts with itself: only the first of equal rows can ever be kept
    slim = df.groupBy(*by, *geometry).agg(F.min("__prio").alias("__prio"))
    todo = cut_lineage(slim)
    kept = None
    while not todo.isEmpty():
        first = _cells(todo, by, register).groupBy("__cell").agg(F.min("__prio").alias("__first"))
        near = join_groups(_cells(todo, by, probe), first, ["__cell"])
        wins = near.groupBy(*by, *geometry, "__prio").agg(F.min("__first").alias("__first")).filter(
            F.col("__first") >= F.col("__prio")).drop("__first")
        wins = cut_lineage(wins)
        if wins.isEmpty():
            raise ValueError("the order must be total")
        kept = wins if kept is None else kept.unionByName(wins)
        k = _cells(wins, by, register).select("__cell", F.struct(*by, *geometry, "__prio").alias("k"))
        u = _cells(todo, by, probe).select("__cell", F.struct(*by, *geometry, "__prio").alias("u"))
        same = [F.col(f"k.{b}") == F.col(f"u.{b}") for b in by]
        hit = u.join(k, "__cell").filter(F.col("k.__prio") <= F.col("u.__prio"))
        for s in same:
            hit = hit.filter(s)
        hit = hit.filter((F.col("k.__prio") == F.col("u.__prio")) | conflict("k.", "u."))
        gone = hit.select("u.*").select(*by, "__prio").distinct()
        todo = cut_lineage(todo.join(gone, [*by, "__prio"], "left_anti"))
    return df.join(kept.select(*by, "__prio", F.lit(True).alias("kept")), [*by, "__prio"], "left").fillna(False, ["kept"])
