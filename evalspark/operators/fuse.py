"""Fusion of predictions: over seeds, over the instances of a bag, over scales and views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.columns import clip
from evalspark.operators import metrics as M
from evalspark.plans.groups import first_per_group, join_groups, top_per_group

HOW = ("mean", "topk", "max", "frac")


def ensemble(P: DataFrame, by: Sequence[str] = ("cohort", "arm"), item: str = "item_id", over: str = "seed",
             strict: bool = True) -> DataFrame:
    """Mean score of every item over the runs of a group with at least two runs. Strict: an item missing in a run is
    an error; otherwise only items present in every run are kept."""
    by = list(by)
    runs = P.select(*by, over).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("runs"))
    per_item = P.groupBy(*by, item).agg(F.avg("p").alias("p"), F.max("y").alias("y"),
                                        F.count(F.lit(1)).alias("__n"))
    t = join_groups(per_item, runs.filter("runs >= 2"), by)
    if strict:
        message = F.concat(F.lit("runs differ in item "), F.col(item).cast("string"))
        t = t.withColumn("p", F.when(F.col("__n") == F.col("runs"), F.col("p")).otherwise(
            F.raise_error(message).cast("double")))
    else:
        t = t.filter(F.col("__n") == F.col("runs"))
    return t.select(*by, item, "y", "p", "runs")


def bag_scores(I: DataFrame, by: Sequence[str], how: str = "mean", k: int = 3, t: float = 0.5,
               fallback: DataFrame | None = None) -> DataFrame:
    """One score per bag from its instance scores: mean, max, mean of the k highest, or the share at or above t.
    With `fallback` (bag keys and p) a bag without instances keeps its own whole-item score."""
    by = list(by)
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    if how == "topk":
        out = top_per_group(I, by, k, [F.col("p").desc()]).groupBy(*by).agg(F.avg("p").alias("p"))
    else:
        agg = {"mean": F.avg("p"), "max": F.max("p"), "frac": F.avg((F.col("p") >= t).cast("double"))}[how]
        out = I.groupBy(*by).agg(agg.alias("p"))
    if fallback is None:
        return out
    rest = [c for c in fallback.columns if c not in (*by, "p")]
    whole = fallback.withColumnRenamed("p", "__whole")
    return whole.join(out, by, "left").select(*by, *rest, F.coalesce("p", "__whole").alias("p"),
                                              F.col("p").isNull().alias("scored_whole"))


def multi_scale(I: DataFrame, by: Sequence[str], inst: str = "inst_id") -> DataFrame:
    """Mean over the scales of each instance."""
    return I.groupBy(*by, inst).agg(F.avg("p").alias("p"))


def view_mean(V: DataFrame, by: Sequence[str], n: int, view: str = "view") -> DataFrame:
    """Logarithm of the clamped mean over the first n views."""
    return V.filter(F.col(view) < n).groupBy(*by).agg(F.log(clip(F.avg("p"), 1e-12, 1.0)).alias("log_p"))


def compare_scorings(I: DataFrame, P: DataFrame, k: int = 3, by: Sequence[str] = ("arm",)) -> DataFrame:
    """AUC of the whole-item score and of each bag score, per arm (or `by`), mean and sd over seeds. Labels and whole
    scores come from P; instances carry (by, seed, item_id, p) and are read once: one sort gives all scores of a bag."""
    run = [*by, "seed"]
    key = ["item_id", *run]  # item first: its numbers tell most rows apart in a sort
    ranked = I.select(*key, "p").withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("p").desc())))
    bags = ranked.groupBy(*key).agg(F.round(F.avg("p"), 12).alias("mean"), F.max("p").alias("max"), F.round(F.avg(
        F.when(F.col("__rn") <= k, F.col("p"))), 12).alias("topk"))  # rounded, so that equal means tie whatever the order of the sum
    j = P.select(*key, "y", F.col("p").alias("whole")).join(bags.hint("merge"), key, "left")
    names = ("whole", "mean", "topk", "max")
    j = j.select(*run, "y", *[F.coalesce(n, "whole").alias(n) for n in names])
    auc = M.roc_auc(M.to_long(j, [*run, "y"], names, "scoring"), [*run, "scoring"])
    return auc.groupBy(*by, "scoring").agg(F.count(F.lit(1)).alias("seeds"), F.avg("roc_auc").alias("auc_mean"),
                                           F.stddev_samp("roc_auc").alias("auc_sd"))


def score_drift(a: DataFrame, b: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Largest and mean absolute difference between two scorings."""
    j = a.select(*on, F.col("p").alias("__a")).join(b.select(*on, F.col("p").alias("__b")), list(on))
    d = F.abs(F.col("__a") - F.col("__b"))
    return j.groupBy(*by).agg(F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), F.count(F.lit(1)).alias("items"))


def alignment_report(P: DataFrame, by: Sequence[str] = ("cohort",), run: Sequence[str] = ("arm", "seed"),
                     item: str = "item_id") -> DataFrame:
    """Per group: runs, items, items missing in a run and items whose label differs between runs."""
    by, run = list(by), list(run)
    runs = P.select(*by, *run).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("runs"))
    per_item = P.groupBy(*by, item).agg(F.count(F.lit(1)).alias("n"), (F.min("y") != F.max("y")).alias("mixed"))
    counts = per_item.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("items"),
                                            F.count(F.when(F.col("mixed"), 1)).alias("mixed"))
    return counts.join(runs, by).groupBy(*by).agg(
        F.max("runs").alias("runs"), F.sum("items").alias("items"),
        F.sum(F.when(F.col("n") != F.col("runs"), F.col("items")).otherwise(0)).alias("incomplete_items"),
        F.sum("mixed").alias("label_conflicts"))


def assert_aligned(P: DataFrame, **kw) -> DataFrame:
    """The report, failing when a run misses an item or disagrees on a label."""
    t = alignment_report(P, **kw)
    bad = (F.col("incomplete_items") > 0) | (F.col("label_conflicts") > 0)
    return t.withColumn("items", F.when(bad, F.raise_error(F.lit("runs are not aligned")).cast("bigint"))
                        .otherwise(F.col("items")))


def exemplar(I: DataFrame, n: int, run: Sequence[str] = ("seed",), item: str = "item_id",
             inst: str = "inst_id") -> DataFrame:
    """Of the items with exactly n instances in every run: the one whose lowest run-mean instance score is highest
    (first item on ties)."""
    run = list(run)
    runs = I.select(*run).distinct().agg(F.count(F.lit(1)).alias("runs"))
    per_inst = I.groupBy(item, inst).agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("seen"))
    per_item = per_inst.groupBy(item).agg(F.min("p").alias("low"), F.count(F.lit(1)).alias("n"),
                                          F.min("seen").alias("lo"), F.max("seen").alias("hi"))
    full = runs.select("runs").scalar()
    ok = (F.col("n") == n) & (F.col("lo") == full) & (F.col("hi") == full)
    return per_item.filter(ok).agg(F.max(F.struct(F.col("low"), (-F.col(item)).alias("m"))).alias("b")).select(
        (-F.col("b.m")).alias(item), F.col("b.low").alias("lowest"))


def confident_examples(P: DataFrame, k: int, unit: str = "unit", item: str = "item_id") -> DataFrame:
    """Per class: items by the smallest over arms of the seed-mean score of the true class, one per unit, first k."""
    own = F.when(F.col("y") == 1, F.col("p")).otherwise(1.0 - F.col("p"))
    arm = P.groupBy("y", unit, item, "arm").agg(F.avg(own).alias("c"))
    conf = arm.groupBy("y", unit, item).agg(F.round(F.min("c"), 9).alias("confidence"))
    best = first_per_group(conf, ["y", unit], [-F.col("confidence"), F.col(item)])
    return top_per_group(best, ["y"], k, [F.col("confidence").desc(), F.col(item)])
