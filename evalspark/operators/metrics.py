"""Classification metrics over prediction tables: one row per group `by`.

A prediction table holds a 0/1 label `y` and a score `p`. Score-ordered metrics first reduce the rows to one row per
distinct score (a partial aggregate) and only then order anything.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import finite, ratio, score_bin
from evalspark.plans.prefix import exact_quantiles, mann_whitney, running_totals

DEGENERATE_RATE = 0.95


# --- decisions and confusion counts ---

def decide(P: DataFrame, t=0.5, p: str = "p", out: str = "pred") -> DataFrame:
    """Positive when the score reaches the threshold (a tie is positive)."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    return P.withColumn(out, (F.col(p) >= t).cast("int"))


def _cell(i: int, j: int) -> str:
    return f"n_{i}_{j}"


def confusion(P: DataFrame, by: Sequence[str], classes: Sequence[int] = (0, 1), y: str = "y",
              pred: str = "pred") -> DataFrame:
    """Counts n_<true>_<predicted> over a fixed class list, in one aggregate."""
    return P.groupBy(*by).agg(*[
        F.count(F.when((F.col(y) == i) & (F.col(pred) == j), 1)).alias(_cell(i, j)) for i in classes for j in classes])


def _sum(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _mean_present(cols: Sequence[Column]) -> Column:
    """Mean of the non-NULL entries."""
    n = _sum([c.isNotNull().cast("int") for c in cols])
    return F.when(n > 0, _sum([F.coalesce(c, F.lit(0.0)) for c in cols]) / n)


def threshold_metrics(P: DataFrame, by: Sequence[str], classes: Sequence[int] = (0, 1), y: str = "y",
                      pred: str = "pred") -> DataFrame:
    """Accuracy, balanced accuracy, kappa and macro / per-class precision, recall, F1 and specificity.

    Balanced accuracy averages the classes present in the labels; macro precision, recall and F1 count an undefined
    class as 0, and specificity counts a class without negatives as 1.
    """
    return _threshold_values(confusion(P, by, classes, y, pred), by, classes)


def _threshold_values(cm: DataFrame, by: Sequence[str], classes: Sequence[int]) -> DataFrame:
    n = _sum([F.col(_cell(i, j)) for i in classes for j in classes])
    tp = {c: F.col(_cell(c, c)) for c in classes}
    actual = {c: _sum([F.col(_cell(c, j)) for j in classes]) for c in classes}
    called = {c: _sum([F.col(_cell(i, c)) for i in classes]) for c in classes}
    zero = F.lit(0.0)
    precision = {c: F.coalesce(ratio(tp[c], called[c]), zero) for c in classes}
    recall = {c: F.coalesce(ratio(tp[c], actual[c]), zero) for c in classes}
    f1 = {c: F.coalesce(ratio(2 * tp[c], actual[c] + called[c]), zero) for c in classes}
    spec = {c: F.coalesce(ratio(n - actual[c] - called[c] + tp[c], n - actual[c]), F.lit(1.0)) for c in classes}
    accuracy = ratio(_sum(list(tp.values())), n)
    chance = _sum([actual[c].cast("double") * called[c] for c in classes]) / (n.cast("double") * n)
    k = F.lit(float(len(classes)))
    macro = {"macro_precision": precision, "macro_recall": recall, "macro_f1": f1, "macro_specificity": spec}
    return cm.select(
        *by, accuracy.alias("accuracy"),
        _mean_present([ratio(tp[c], actual[c]) for c in classes]).alias("balanced_accuracy"),
        ratio(accuracy - chance, F.lit(1.0) - chance).alias("kappa"),
        *[(_sum(list(v.values())) / k).alias(name) for name, v in macro.items()],
        *[v[c].alias(f"{name}_{c}") for name, v in (("precision", precision), ("recall", recall), ("f1", f1),
                                                    ("specificity", spec)) for c in classes])


def macro_f1_present(P: DataFrame, by: Sequence[str], classes: Sequence[int] = (0, 1), weight=None, y: str = "y",
                     pred: str = "pred") -> DataFrame:
    """Macro-F1 over the classes that occur in labels or predictions; `weight` counts a row several times."""
    w = F.lit(1) if weight is None else F.col(weight)
    t = P.groupBy(*by).agg(*[
        F.sum(F.when((F.col(y) == c) & (F.col(pred) == c), w).otherwise(0)).alias(f"tp_{c}") for c in classes], *[
        F.sum(w * ((F.col(y) == c).cast("int") + (F.col(pred) == c).cast("int"))).alias(f"d_{c}") for c in classes])
    return t.select(*by, _mean_present([ratio(2 * F.col(f"tp_{c}"), F.col(f"d_{c}")) for c in classes])
                    .alias("macro_f1"))


def mcc_of(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    tp, fp, fn, tn = [c.cast("double") for c in (tp, fp, fn, tn)]
    den = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(F.lit(0.0))


def degenerate(rate: Column) -> Column:
    return (rate >= DEGENERATE_RATE) | (rate <= 1.0 - DEGENERATE_RATE)


def decision_values(P: DataFrame, by: Sequence[str], pred: str = "pred") -> DataFrame:
    """Sensitivity, specificity, their mean, MCC (0 when undefined) and the positive rate of a binary decision."""
    return _decision_values(confusion(P, by, (0, 1), "y", pred), by)


def _decision_values(cm: DataFrame, by: Sequence[str]) -> DataFrame:
    tn, fp, fn, tp = (F.col(_cell(i, j)) for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)))
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    rate = ratio(tp + fp, tn + fp + fn + tp)
    return cm.select(*by, ((sens + spec) / 2).alias("balanced_accuracy"), sens.alias("sensitivity"),
                     spec.alias("specificity"), mcc_of(tp, fp, fn, tn).alias("mcc"), rate.alias("positive_rate"),
                     degenerate(rate).alias("degenerate"))


# --- ranking ---

def score_histogram(P: DataFrame, by: Sequence[str], y="y", p="p", weight=None) -> DataFrame:
    """One row per (group, distinct score): positives, negatives and the count of unusable scores (`bad`)."""
    y, p = (F.col(c) if isinstance(c, str) else c for c in (y, p))
    w = F.lit(1) if weight is None else F.col(weight)
    ok = finite(p)
    d = P.select(*by, y.alias("__y"), F.when(ok, p.cast("double")).alias("p"), w.alias("__w"))
    return d.groupBy(*by, "p").agg(
        F.sum(F.when(F.col("__y") == 1, F.col("__w")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("__y") != 1, F.col("__w")).otherwise(0)).alias("neg"),
        F.sum(F.when(F.col("p").isNull(), F.col("__w")).otherwise(0)).alias("bad"))


def auc_of_histogram(hist: DataFrame, by: Sequence[str], out: str = "roc_auc") -> DataFrame:
    t = mann_whitney(hist, by, "p", ["bad"])
    usable = (F.col("pos") > 0) & (F.col("neg") > 0) & (F.col("bad") == 0)
    return t.select(*by, F.when(usable, F.col("two_u") / (2.0 * F.col("pos").cast("double") * F.col("neg")))
                    .alias(out))


def roc_auc(P: DataFrame, by: Sequence[str], y="y", p="p", weight=None, out: str = "roc_auc") -> DataFrame:
    """Area under the ROC curve with tied scores averaged; NULL without both classes or with an unusable score."""
    return auc_of_histogram(score_histogram(P, by, y, p, weight), by, out)


def _descending(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    # tested on the aggregates and not on p: a test of a grouping key would be pushed below the aggregate
    scored = hist.filter((F.col("bad") == 0) & (F.col("pos") + F.col("neg") > 0))
    t = running_totals(scored, by, "p", ["pos", "neg"], descending=True)
    return t.select(*by, "p", "pos", "neg", (F.col("pos_before") + F.col("pos")).alias("tp"),
                    (F.col("neg_before") + F.col("neg")).alias("fp"), F.col("pos_total").alias("n_pos"),
                    F.col("neg_total").alias("n_neg"))


def ap_of_histogram(hist: DataFrame, by: Sequence[str], out: str = "average_precision") -> DataFrame:
    t = _descending(hist, by)
    step = F.col("pos").cast("double") * ratio("tp", F.col("tp") + F.col("fp"))
    return t.groupBy(*by).agg((F.sum(step) / F.max("n_pos")).alias("__ap"), F.max("n_pos").alias("__n")).select(
        *by, F.when(F.col("__n") > 0, F.col("__ap")).alias(out))


def average_precision(P: DataFrame, by: Sequence[str], positive: int = 1, weight=None,
                      out: str = "average_precision") -> DataFrame:
    """Step sum of precision over distinct scores; `positive=0` takes the negative class with score 1 - p."""
    if positive == 1:
        hist = score_histogram(P, by, weight=weight)
    else:
        hist = score_histogram(P, by, F.lit(1) - F.col("y"), F.lit(1.0) - F.col("p"), weight)
    return ap_of_histogram(hist, by, out)


def roc_curve(P: DataFrame, by: Sequence[str]) -> DataFrame:
    """ROC point of every distinct threshold (the starting point (0, 0) is left out)."""
    t = _descending(score_histogram(P, by), by)
    return t.select(*by, F.col("p").alias("threshold"), "tp", "fp", ratio("fp", "n_neg").alias("fpr"),
                    ratio("tp", "n_pos").alias("tpr"))


def sens_at_spec(P: DataFrame, by: Sequence[str], specificity: float, out: str = "sens_at_spec",
                 curve: DataFrame | None = None) -> DataFrame:
    """Largest sensitivity whose false positive rate stays within 1 - specificity (+1e-9)."""
    curve = roc_curve(P, by) if curve is None else curve
    ok = F.col("fpr") <= F.lit(1 - specificity + 1e-9)
    return curve.groupBy(*by).agg(F.coalesce(F.max(F.when(ok, F.col("tpr"))), F.lit(0.0)).alias(out))


def auc_vs_reference(P: DataFrame, by: Sequence[str], subtype: str, reference: str) -> DataFrame:
    """AUC of every subtype against the reference negatives, without repeating the negatives per subtype: negatives
    are counted once per score, and each subtype's positives read the running count at their score."""
    hist = P.groupBy(*by, "p").agg(F.count(F.when(F.col(subtype) == reference, 1)).alias("neg"))
    below = running_totals(hist, by, "p", ["neg"])
    pos = P.filter(F.col(subtype) != reference).groupBy(*by, subtype, "p").agg(F.count(F.lit(1)).alias("pos"))
    t = pos.join(below, [*by, "p"])
    two_u = F.sum(F.col("pos").cast("double") * (2.0 * F.col("neg_before") + F.col("neg")))
    return t.groupBy(*by, subtype).agg(
        two_u.alias("__u"), F.sum("pos").alias("n_pos"), F.max("neg_total").alias("n_neg")).select(
        *by, subtype, "n_pos", "n_neg",
        F.when(F.col("n_neg") > 0, F.col("__u") / (2.0 * F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"))


def to_long(Fr: DataFrame, by: Sequence[str], cols: Sequence[str], name: str = "feature",
            value: str = "p") -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols]))
    return Fr.select(*by, cells.alias("__c")).select(*by, "__c.*")


def feature_auc(Fr: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """AUC of each single feature, nothing fitted, and its distance from 0.5."""
    t = roc_auc(to_long(Fr, [*by, "y"], cols), [*by, "feature"])
    return t.withColumn("distance", F.abs(F.col("roc_auc") - 0.5))


# --- probabilities ---

def brier(P: DataFrame, by: Sequence[str]) -> DataFrame:
    """Brier score and its skill against the constant prevalence predictor."""
    err = F.col("p") - F.col("y")
    t = P.groupBy(*by).agg(F.avg(err * err).alias("brier"), F.avg(F.col("y").cast("double")).alias("prevalence"))
    base = F.col("prevalence") * (1.0 - F.col("prevalence"))
    return t.withColumn("brier_skill", F.lit(1.0) - ratio("brier", base))


def _bins(P: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    rows = P.select(*by, "y", F.when(finite("p"), F.col("p")).alias("p"))
    rows = rows.select(*by, "y", "p", F.coalesce(score_bin("p", bins), F.lit(-1)).alias("bin"))
    return rows.groupBy(*by, "bin").agg(
        F.count("p").alias("n"), F.sum(F.col("p").cast("decimal(28,18)")).cast("double").alias("sp"), F.sum(F.col("y").cast("bigint")).alias("sy")).filter("n > 0")


def ece(P: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    gap = F.abs(F.col("sy") - F.col("sp"))
    return _bins(P, by, bins).groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def reliability(P: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean score, positive fraction and count of every bin, empty bins included."""
    b = _bins(P, by, bins)
    frame = b.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(b, [*by, "bin"], "left").select(
        *by, "bin", (F.col("bin") / float(bins)).alias("bin_low"), ((F.col("bin") + 1) / float(bins)).alias("bin_high"),
        (F.col("sp") / F.col("n")).alias("mean_p"), (F.col("sy") / F.col("n")).alias("fraction_positive"),
        F.coalesce("n", F.lit(0)).alias("count"))


def diagnostics(P: DataFrame, by: Sequence[str], pred: str = "pred") -> DataFrame:
    """Positive rate, mean score per true class and the one-class flag."""
    rate = F.avg((F.col(pred) == 1).cast("double"))
    t = P.groupBy(*by).agg(
        rate.alias("positive_rate"), F.avg(F.when(F.col("y") == 0, F.col("p"))).alias("mean_p_on_negatives"),
        F.avg(F.when(F.col("y") == 1, F.col("p"))).alias("mean_p_on_positives"))
    return t.withColumn("degenerate", degenerate(F.col("positive_rate")))


def degeneracy(P: DataFrame, by: Sequence[str], pred: str = "pred") -> DataFrame:
    """Most frequently predicted class (lowest class on ties), its rate and a note when it is nearly the only one."""
    c = P.groupBy(*by, pred).agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy(*by).agg(F.max(F.struct(F.col("n"), (-F.col(pred)).alias("m"))).alias("top"),
                           F.sum("n").alias("total"))
    return t.select(*by, (-F.col("top.m")).alias("dominant"), ratio("top.n", "total").alias("rate")).withColumn(
        "note", F.when(F.col("rate") >= DEGENERATE_RATE, "degenerate").otherwise(""))


def subset_median(P: DataFrame, by: Sequence[str], condition: Column, over: str = "seed") -> DataFrame:
    """Exact median score of a subset per run, averaged over runs."""
    med = exact_quantiles(P.filter(condition), [*by, over], "p", {"median": 0.5})
    return med.groupBy(*by).agg(F.avg("median").alias("median_p"))


def nll(P: DataFrame, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Weighted mean negative log likelihood of stored probabilities, clamped at 1e-12."""
    own = F.when(F.col("y") == 1, F.col("p")).otherwise(1.0 - F.col("p"))
    loss = F.when(own.isNotNull(), -F.log(F.greatest(own, F.lit(1e-12))))
    w = F.lit(1.0) if weight is None else F.col(weight)
    return P.groupBy(*by).agg((F.sum(loss * w) / F.sum(F.when(loss.isNotNull(), w))).alias("nll"))


def ranking_metrics(P: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUC, average precision, sensitivity at 90 / 95 % specificity, Brier and prevalence from one score histogram."""
    ranked = _descending(score_histogram(P, by), by)
    n = F.col("pos") + F.col("neg")
    fpr, tpr = ratio("fp", "n_neg"), ratio("tp", "n_pos")
    # each positive beats the negatives not yet passed and half of its ties
    wins = F.col("pos").cast("double") * (2.0 * (F.col("n_neg") - F.col("fp")) + F.col("neg"))
    sq = F.col("pos") * (1.0 - F.col("p")) * (1.0 - F.col("p")) + F.col("neg") * F.col("p") * F.col("p")
    at = {f"sens_at_spec{s}": F.coalesce(F.max(F.when(fpr <= 1 - s / 100 + 1e-9, tpr)), F.lit(0.0)) for s in (90, 95)}
    return ranked.groupBy(*by).agg(
        ratio(F.sum(wins), 2.0 * F.max("n_pos").cast("double") * F.max("n_neg")).alias("roc_auc"),
        ratio(F.sum(F.col("pos") * ratio("tp", F.col("tp") + F.col("fp"))), F.max("n_pos")).alias("average_precision"),
        (F.max("n_pos") / (F.max("n_pos") + F.max("n_neg"))).alias("prevalence"),
        (F.sum(sq) / F.sum(n)).alias("brier"), *[v.alias(k) for k, v in at.items()])


def cohort_metrics(P: DataFrame, by: Sequence[str], threshold=0.5) -> DataFrame:
    """The whole bundle per run: one histogram for everything ranked, one aggregate for the bins and one for the
    decision; only one row per run is joined."""
    d = decide(P, threshold)
    cm = confusion(d, by)
    t = _threshold_values(cm, by, (0, 1)).select(*by, "macro_f1", "accuracy")
    return (ranking_metrics(P, by).join(ece(P, by), list(by))
            .join(_decision_values(cm, by).drop("degenerate").join(t, list(by)), list(by)))


def family_score(P: DataFrame, by: Sequence[str], family: str, selected: Sequence[str]) -> DataFrame:
    """Per group: J, the mean over the selected families of half AUC plus half macro-F1 at 0.5."""
    keys = [*by, family]
    t = roc_auc(P, keys).join(threshold_metrics(decide(P), keys).select(*keys, "macro_f1"), keys)
    return t.filter(F.col(family).isin(*selected)).groupBy(*by).agg(
        F.avg(0.5 * F.col("roc_auc") + 0.5 * F.col("macro_f1")).alias("score_j"))


def family_metrics(P: DataFrame, by: Sequence[str], family: str) -> DataFrame:
    """AUC, macro-F1 and positive rate per perturbation family."""
    keys = [*by, family]
    d = decide(P)
    return (roc_auc(P, keys).join(threshold_metrics(d, keys).select(*keys, "macro_f1"), keys)
            .join(d.groupBy(*keys).agg(F.avg(F.col("pred").cast("double")).alias("positive_rate")), keys))


# --- localisation ---

def localisation(G: DataFrame, by: Sequence[str], cut: float = 0.45) -> DataFrame:
    """Per heat map: is the first peak inside the mask, share of energy inside, IoU of the map above `cut`."""
    hot, inside = F.col("heat") >= cut, F.col("mask") > 0
    peak = F.max(F.struct("heat", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"), "mask"))
    t = G.groupBy(*by).agg(peak.alias("peak"), F.sum("heat").alias("total"),
                           F.sum(F.when(inside, F.col("heat")).otherwise(0.0)).alias("in_mask"),
                           F.count(F.when(hot & inside, 1)).alias("inter"), F.count(F.when(hot | inside, 1)).alias("uni"))
    energy = F.when(F.col("total") < 1e-8, F.lit(0.0)).otherwise(
        F.least(F.lit(100.0), F.col("in_mask") / F.col("total") * 100.0))
    return t.select(*by, ((F.col("peak.heat") != 0) & (F.col("peak.mask") > 0)).alias("peak_in_mask"),
                    energy.alias("energy_in_mask"), F.coalesce(ratio("inter", "uni") * 100.0, F.lit(100.0)).alias("iou"))


def drop_increase(original: DataFrame, masked: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Average relative drop (%) and the rate (%) of items whose masked score is higher. Both sides hold a row per item and
    run; where a generator made them, Spark's estimate is far below their size, so the join asks for a shuffle."""
    j = original.select(*on, F.col("p").alias("p0")).join(masked.select(*on, F.col("p").alias("p1")).hint("merge"), list(on))
    drop = F.when(F.col("p0") <= 1e-8, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), (F.col("p0") - F.col("p1")) / F.col("p0")) * 100.0)
    return j.groupBy(*by).agg(F.avg(drop).alias("average_drop"),
                              (F.avg((F.col("p1") > F.col("p0")).cast("double")) * 100.0).alias("increase_rate"))


def weighted_mean(df: DataFrame, by: Sequence[str], weight: str, cols: Sequence[str]) -> DataFrame:
    """Batch means combined by their item counts."""
    w = F.col(weight)
    return df.groupBy(*by).agg(*[
        (F.sum(F.col(c) * w) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(c) for c in cols])


def seed_summary(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sample sd (NULL for one run) and whether every run is above 0."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seeds"), *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_samp(m).alias(f"{m}_sd") for m in metrics],
        *[F.when(F.count(m) > 1, F.bool_and(F.col(m) > 0)).alias(f"{m}_positive") for m in metrics])
