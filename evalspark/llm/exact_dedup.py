"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import join_by_size, plain, text_or_empty
from evalspark.plans.lineage import cut_lineage


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                run_bits: int = 4, round_bits: int = 2) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    Rows are dealt into 2^run_bits runs by their id. A run holds one entry per text: the digest, the identifier that
    stays and the number of rows. In every round a run whose number ends in set bits sends its entries to the run with
    those bits cleared (a binomial tree, 2^round_bits runs meeting at a time), where they are merged in digest order:
    the aggregate over a struct is a sort-merge one, so each task merges sorted entries. Entries meet only when two
    independent digests and the length agree, at every level. All digests of a run are spread over the cluster, so no
    level passes through one task, and a text with a third of all rows is one entry per run.

    NULL text counts as empty. `keep` is "smallest" or "largest". Repeated rows of one id: the row count counts them
    all, and all of them are `kept` if the id is. NULL ids stay only where a text has no other id. Columns beside the
    two named ones are not read. An empty table gives an empty result.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    base = plain(docs, doc_id=id_col, text=text_col).withColumn("text", text_or_empty())
    rows = cut_lineage(base.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.xxhash64("text").alias("check"),
                                   F.length("text").alias("length")))
    key = ["text_sha256", "check", "length"]
    run = F.pmod(F.xxhash64("doc_id"), F.lit(1 << run_bits))
    best = pick(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id"))).alias("best")
    runs = rows.groupBy(run.alias("run"), *key).agg(best, F.count(F.lit(1)).alias("n"))
    for _ in range(-(-run_bits // round_bits)):
        runs = runs.groupBy(F.shiftright("run", round_bits).alias("run"), *key).agg(pick("best").alias("best"),
                                                                                     F.sum("n").alias("n"))
    groups = cut_lineage(runs.select(*key, F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), "n"))
    return join_by_size(rows, groups, key, "n").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
