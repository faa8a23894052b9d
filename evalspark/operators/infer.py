"""Resampling inference: unit draws as weights, paired / grouped / hierarchical bootstrap, Holm, t tests, ranks.

A unit carries its weights of all draws as one vector, made once and shared by every arm and metric. Items are reduced
to counts per (unit, score) before they meet the weights. Draw -1 gives every unit weight 1: the observed value comes
out of the same plan as the resamples.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.columns import draw_index, ratio
from evalspark.functions.student import t_quantile975, t_two_sided
from evalspark.operators import metrics as M
from evalspark.plans.groups import join_groups, rank_rows
from evalspark.plans.lineage import stored
from evalspark.plans.vectors import draw_totals, draw_vectors, score_sums, sums_metrics, unpacked, vector_metrics

METRICS = ("roc_auc", "average_precision", "macro_f1")
OBSERVED = -1
ALPHA = 0.05


# --- units and draws ---

def units(P: DataFrame, strata: Sequence[str] = ("cohort", "y"), unit: str = "unit") -> DataFrame:
    """Resampling units per stratum with an index 0..n-1, the stratum size n and the rows of the unit."""
    strata = list(strata)
    u = P.groupBy(*strata, unit).agg(F.count(F.lit(1)).alias("rows"))
    ranked = rank_rows(u, strata, [unit], "idx").withColumn("idx", F.col("idx") - 1)
    n = ranked.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    return join_groups(ranked, n, strata)


def guard_units(P: DataFrame, unit: str = "unit", by: Sequence[str] = ("cohort",)) -> DataFrame:
    """P, failing on a unit that holds both classes."""
    by = list(by)
    mixed = P.groupBy(*by, unit).agg(F.countDistinct("y").alias("k")).filter("k > 1").limit(1)
    n = mixed.agg(F.count(F.lit(1)).alias("n"))
    stop = F.raise_error(F.lit("a resampling unit must not mix classes")).cast("int")
    return P.withColumn("y", F.when(n.select("n").scalar() > 0, stop).otherwise(F.col("y")))


def draw_units(U: DataFrame, n_boot: int, seed: int = 0, strata: Sequence[str] = ("cohort", "y"),
               unit: str = "unit") -> DataFrame:
    """n units with replacement within each stratum, as (stratum, unit, draw, weight)."""
    return unpacked(draw_vectors(U, n_boot, seed, strata, unit), n_boot, strata, unit)


def draw_unit_totals(U: DataFrame, n_boot: int, seed: int = 0, strata: Sequence[str] = ("cohort", "y"),
                     unit: str = "unit") -> DataFrame:
    """How many units each draw of `draw_units` holds per stratum, their summed and their largest weight, without a row per
    unit and draw."""
    return draw_totals(draw_vectors(U, n_boot, seed, strata, unit), n_boot, strata)


def draw_items(P: DataFrame, n_boot: int, seed: int = 0, by: Sequence[str] = ("cohort",),
               item: str = "item_id") -> DataFrame:
    """n of n items with replacement, without strata."""
    U = units(P.select(*by, F.col(item).alias("unit")).distinct(), by)
    return draw_units(U, n_boot, seed, by).withColumnRenamed("unit", item)


@dataclass(frozen=True)
class Weights:
    """One row per unit with the vector of its weights, the observed weight first."""

    vectors: DataFrame
    n_boot: int


def unit_weights(U: DataFrame, n_boot: int, seed: int = 0, strata: Sequence[str] = ("cohort", "y"), unit: str = "unit") -> Weights:
    return Weights(stored(draw_vectors(U, n_boot, seed, strata, unit), "weights"), n_boot)


def make_weights(P: DataFrame, n_boot: int, seed: int = 0, strata: Sequence[str] = ("cohort", "y"),
                 unit: str = "unit") -> Weights:
    return unit_weights(units(P, strata, unit), n_boot, seed, strata, unit)


def weighted_metrics(P: DataFrame, weights: Weights, by: Sequence[str], strata: Sequence[str] = ("cohort", "y"),
                     unit: str = "unit", threshold: float = 0.5, metrics: Sequence[str] = METRICS) -> DataFrame:
    """AUC, average precision and macro-F1 (classes present) of every (group, draw), in long form; NULL where a class has
    no weight or a score is unusable."""
    return _long_metrics(vector_metrics(P, weights.vectors, weights.n_boot, by, strata, unit, threshold), by, metrics)


def _long_metrics(t: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    keys = [*by, "draw"]
    np_, nn, tp, fp = (F.col(c) for c in ("n_pos", "n_neg", "tp", "fp"))
    f1 = M._mean_present([ratio(2 * tp, np_ + tp + fp), ratio(2 * (nn - fp), 2 * nn + np_ - tp - fp)])
    value = {"roc_auc": ratio(2.0 * np_ * nn - F.col("lost"), 2.0 * np_ * nn),
             "average_precision": ratio("ap", "n_pos"), "macro_f1": f1}
    usable = F.col("bad") == 0
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.when(usable, value[m]).alias("value")) for m in metrics]))
    return t.select(*keys, long.alias("m")).select(*keys, "m.*")


# --- summaries of draws ---

def _resampled(c: str = "d") -> Column:
    return F.when(F.col("draw") != OBSERVED, F.col(c))


def _interval(c: str = "d") -> list[Column]:
    """A group holds one value per draw, so the exact percentile is bounded by the number of draws."""
    d = _resampled(c)
    return [F.percentile(d, 0.025).alias("ci_low"), F.percentile(d, 0.975).alias("ci_high")]


def _p_value(floor: Column, c: str = "d") -> Column:
    d = _resampled(c)
    low, high = F.avg((d <= 0).cast("double")), F.avg((d >= 0).cast("double"))
    return F.least(F.lit(1.0), F.greatest(floor, 2.0 * F.least(low, high)))


def _observed(c: str) -> Column:
    return F.max(F.when(F.col("draw") == OBSERVED, F.col(c)))


def _delta_summary(deltas: DataFrame, by: Sequence[str], floor: Column, observed: Sequence[str] = ()) -> DataFrame:
    return deltas.groupBy(*by).agg(_observed("d").alias("delta"), *_interval(), _p_value(floor).alias("p"),
                                   *[_observed(c).alias(c) for c in observed])


def paired_bootstrap(P: DataFrame, reference: str, baselines: Sequence[str] | None = None, n_boot: int = 1000,
                     seed: int = 0, weights: Weights | None = None, unit: str = "unit") -> DataFrame:
    """Reference minus baseline per cohort, seed, baseline and metric on shared draws: observed difference, 95 %
    percentile interval, two-sided p floored at 1 / (valid draws + 1)."""
    if baselines is not None:
        P = P.filter(F.col("arm").isin(reference, *baselines))
    weights = make_weights(P, n_boot, seed, unit=unit) if weights is None else weights
    m = weighted_metrics(P, weights, ["cohort", "arm", "seed"], unit=unit)
    keys = ["cohort", "seed", "draw", "metric"]
    ref = m.filter(F.col("arm") == reference).select(*keys, F.col("value").alias("r"))
    base = m.filter(F.col("arm") != reference).select(*keys, F.col("arm").alias("baseline"), "value")
    d = base.join(ref, keys).withColumn("d", F.col("r") - F.col("value"))
    floor = F.lit(1.0) / (F.count(_resampled()) + 1)
    return _delta_summary(d, ["cohort", "seed", "baseline", "metric"], floor)


def absent_baselines(P: DataFrame, reference: str, baselines: Sequence[str]) -> DataFrame:
    """(cohort, seed, baseline) combinations that a reference run would need and that have no predictions."""
    runs = P.select("cohort", "seed", "arm").distinct()
    want = runs.filter(F.col("arm") == reference).select(
        "cohort", "seed", F.explode(F.array(*[F.lit(b) for b in baselines])).alias("baseline"))
    return want.join(runs.withColumnRenamed("arm", "baseline"), ["cohort", "seed", "baseline"], "left_anti")


def holm(df: DataFrame, family: Sequence[str], p: str = "p", order: Sequence[str] = (), out: str = "p_holm") -> DataFrame:
    """Holm step-down adjusted p per family (a family holds one row per test); ties follow `order`."""
    w = Window.partitionBy(*family).orderBy(F.col(p), *order)
    rank = F.row_number().over(w)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = df.withColumn("__step", F.least(F.lit(1.0), (m - rank + 1) * F.col(p)))
    return step.withColumn(out, F.max("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def compare_all(P: DataFrame, reference: str, baselines: Sequence[str], n_boot: int = 1000, seed: int = 0,
                unit: str = "unit") -> DataFrame:
    """Every comparison with its number of units and Holm over (cohort, seed): baselines x metrics."""
    U = units(P, ("cohort", "y"), unit)
    weights = unit_weights(U, n_boot, seed, unit=unit)
    n = U.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_units"))
    t = paired_bootstrap(P, reference, baselines, weights=weights, unit=unit).join(n, "cohort")
    t = holm(t, ["cohort", "seed"], "p", ["baseline", "metric"])
    return t.withColumn("significant", F.when(F.col("p_holm") < ALPHA, "yes").otherwise("no"))


def auc_ci(P: DataFrame, n_boot: int, seed: int = 0, by: Sequence[str] = ("cohort", "arm", "seed"),
           unit: str = "unit") -> DataFrame:
    """AUC of every run with a 95 % percentile interval over units."""
    m = weighted_metrics(P, make_weights(P, n_boot, seed, unit=unit), by, unit=unit, metrics=("roc_auc",))
    d = m.withColumnRenamed("value", "d")
    return d.groupBy(*by).agg(F.max(F.when(F.col("draw") == OBSERVED, F.col("d"))).alias("roc_auc"), *_interval())


def run_bundle(P: DataFrame, n_boot: int, threshold: float = 0.5, seed: int = 0, by: Sequence[str] = ("cohort", "arm", "seed"),
               unit: str = "unit") -> DataFrame:
    """All metrics of every run with the interval of its AUC over units and the threshold its decisions were taken at."""
    ci = auc_ci(P, n_boot, seed, by, unit).select(*by, F.col("ci_low").alias("auc_ci_low"), F.col("ci_high").alias("auc_ci_high"))
    return M.cohort_metrics(P, list(by), threshold).join(ci, list(by)).withColumn("threshold", F.lit(float(threshold)))


# --- methods: units and seeds resampled ---

def seed_draws(m: DataFrame, seed: int = 0) -> DataFrame:
    """Mean over the runs of an arm with the runs themselves resampled: per (cohort, arm, metric, draw), as many runs
    as the arm has, with replacement. The observed draw keeps the plain mean. An arm's runs are few by nature."""
    keys = ["cohort", "arm", "metric", "draw"]
    w = Window.partitionBy(*keys).orderBy("seed")
    runs = m.withColumn("i", F.row_number().over(w) - 1)
    per = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("v"))
    k = F.size("v").cast("bigint")
    picks = F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda j: F.get("v", draw_index(
        k, "cohort", "arm", "metric", "draw", j, F.lit(seed)).cast("int"))["value"])
    plain = F.transform("v", lambda e: e["value"])
    chosen = F.when(F.col("draw") == OBSERVED, plain).otherwise(picks)
    mean = F.aggregate(chosen, F.lit(0.0), lambda a, x: a + x) / F.size("v")
    return per.select(*keys, mean.alias("value"), F.size("v").alias("seeds"))


def method_deltas(arms: DataFrame, pairs: DataFrame, n_boot: int) -> DataFrame:
    """Differences of arm means for a table of pairs (family, reference, comparator)."""
    keys = ["cohort", "metric", "draw"]
    ref, com = (arms.select(*keys, F.col("arm").alias(side), F.col("value").alias(f"{side}_value"), F.col("seeds").alias(f"{side}_seeds"))
                for side in ("reference", "comparator"))
    d = pairs.join(ref, "reference").join(com, [*keys, "comparator"])
    d = d.withColumn("d", F.col("reference_value") - F.col("comparator_value"))
    return _delta_summary(d, ["cohort", "metric", "family", "reference", "comparator", "reference_seeds",
                              "comparator_seeds"], F.lit(1.0 / (n_boot + 1)), ("reference_value", "comparator_value"))


def pair_table(P: DataFrame, families: dict[str, Sequence[tuple[str, str]]]) -> DataFrame:
    rows = [(f, r, c) for f, pairs in families.items() for r, c in pairs]
    return P.sparkSession.createDataFrame(rows, "family string, reference string, comparator string")


def family_tests(P: DataFrame, families: dict[str, Sequence[tuple[str, str]]], n_boot: int, seed: int = 0,
                 seeds: Sequence[int] | None = None, unit: str = "unit", strata: Sequence[str] = ("cohort", "y"),
                 metrics: Sequence[str] = ("roc_auc",)) -> DataFrame:
    """Hierarchical bootstrap of declared pairs: units shared by all arms, then the runs of each arm; observed values of
    both sides, Holm within (cohort, metric, family) and whether that is below ALPHA."""
    if seeds is not None:
        P = P.filter(F.col("seed").isin(*seeds))
    weights = make_weights(P, n_boot, seed, strata, unit)
    m = weighted_metrics(P, weights, ["cohort", "arm", "seed"], strata, unit, metrics=metrics)
    t = method_deltas(seed_draws(m, seed), pair_table(P, families), n_boot)
    t = holm(t, ["cohort", "metric", "family"], "p", ["reference", "comparator"])
    return t.withColumn("significant", F.when(F.col("p_holm") < ALPHA, "yes").otherwise("no"))


def method_tests(P: DataFrame, reference: str, comparators: Sequence[str], n_boot: int, seed: int = 0,
                 unit: str = "unit", strata: Sequence[str] = ("cohort", "y")) -> DataFrame:
    """Reference against every comparator, AUC and average precision, Holm within (cohort, metric)."""
    return family_tests(P, {"methods": [(reference, c) for c in comparators]}, n_boot, seed, unit=unit, strata=strata,
                        metrics=("roc_auc", "average_precision")).drop("family")


def subtype_ci(P: DataFrame, n_boot: int, seed: int = 0, subtype: str = "subtype", reference: str = "base",
               unit: str = "unit") -> DataFrame:
    """Seed-mean AUC of each subtype against the reference class with a percentile interval over units, seeds fixed. Every row
    is summed once; only the sums of the reference class are repeated once per subtype."""
    w = make_weights(P, n_boot, seed, ["cohort", subtype], unit)
    run = ["cohort", "arm", "seed"]
    positive = F.col(subtype) != reference
    sums = score_sums(P.withColumn("y", positive.cast("int")), w.vectors, n_boot, [*run, subtype], ["cohort", subtype], unit)
    own = sums.filter(positive).withColumnRenamed(subtype, "kind")
    kinds = own.select("cohort", "kind").distinct()
    rest = sums.filter(~positive).drop(subtype).join(kinds, "cohort")
    auc = _long_metrics(sums_metrics(own.unionByName(rest), n_boot, [*run, "kind"]), [*run, "kind"], ("roc_auc",))
    auc = auc.select("cohort", "arm", "seed", F.col("kind").alias(subtype), "draw", F.col("value").alias("auc"))
    d = auc.groupBy("cohort", "arm", subtype, "draw").agg(F.avg("auc").alias("d"))
    return d.groupBy("cohort", "arm", subtype).agg(
        F.max(F.when(F.col("draw") == OBSERVED, F.col("d"))).alias("roc_auc"), *_interval())


def unit_sensitivity(P: DataFrame, blocks: DataFrame, reference: str, comparators: Sequence[str], n_boot: int,
                     seed: int = 0) -> DataFrame:
    """The method test with other units (`blocks`: item_id, block, one stratum per subtype) beside the primary one. Blocks are
    as many as the items and P is more, so the join asks for a shuffle."""
    alt = P.join(blocks.hint("merge"), "item_id")
    keys = ["cohort", "metric", "reference", "comparator"]
    a = method_tests(alt, reference, comparators, n_boot, seed, "block", ("cohort", "subtype"))
    b = method_tests(P, reference, comparators, n_boot, seed)
    cols = ("ci_low", "ci_high", "p_holm")
    return a.select(*keys, "delta", "ci_low", "ci_high", "p", "p_holm").join(
        b.select(*keys, *[F.col(c).alias(f"primary_{c}") for c in cols]), keys, "left")


# --- tests on few numbers ---

def t_test(df: DataFrame, by: Sequence[str], side: str, value: str, a: str, b: str) -> DataFrame:
    """Welch's t of mean(a) - mean(b) over the rows marked by `side`; with a single b row, the one-sample t against
    it. 95 % interval of the difference."""
    def part(s: str) -> list[Column]:
        v = F.when(F.col(side) == s, F.col(value))
        return [F.count(v).alias(f"n_{s}"), F.avg(v).alias(f"m_{s}"), (F.var_samp(v) / F.count(v)).alias(f"v_{s}")]

    t = df.groupBy(*by).agg(*[c.alias(c_name) for s, k in ((a, "a"), (b, "b")) for c, c_name in
                              zip(part(s), (f"n_{k}", f"m_{k}", f"v_{k}"))])
    va, vb = F.col("v_a"), F.when(F.col("n_b") > 1, F.col("v_b")).otherwise(F.lit(0.0))
    welch = (va + vb) * (va + vb) / (va * va / (F.col("n_a") - 1) + F.when(F.col("n_b") > 1, vb * vb / (F.col("n_b") - 1))
                                     .otherwise(F.lit(0.0)))
    dof = F.when(F.col("n_b") > 1, welch).otherwise(F.col("n_a") - 1.0)
    t = t.select(*by, F.when(F.col("n_b") > 1, "Welch t").otherwise("one-sample t").alias("test"),
                 F.col("m_a").alias("mean_a"), F.col("m_b").alias("mean_b"), (F.col("m_a") - F.col("m_b")).alias("delta"),
                 F.sqrt(va + vb).alias("se"), dof.alias("df"))
    t = t.withColumn("t", ratio("delta", "se"))
    half = t_quantile975("df") * F.col("se")
    return t.withColumns({"ci_low": F.col("delta") - half, "ci_high": F.col("delta") + half,
                          "p": t_two_sided("t", "df")}).drop("se")


def t_interval(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean with its 95 % t interval (NULL bounds for one value)."""
    t = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = t_quantile975((F.col("n") - 1).cast("double")) * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    half = F.when(F.col("n") > 1, half)
    return t.select(*by, "n", "mean", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def seed_tests(P: DataFrame, reference: str, comparators: Sequence[str], bootstrap: DataFrame) -> DataFrame:
    """Welch t over the seed values of AUC and average precision, Holm, beside the bootstrap's adjusted p."""
    run = ["cohort", "arm", "seed"]
    m = M.to_long(M.ranking_metrics(P, run), run, ("roc_auc", "average_precision"), "metric", "value")
    names = F.array(*[F.lit(c) for c in comparators])
    ref = m.filter(F.col("arm") == reference).withColumn("comparator", F.explode(names)).withColumn("side", F.lit("a"))
    com = m.filter(F.col("arm").isin(*comparators)).withColumn("comparator", F.col("arm")).withColumn("side", F.lit("b"))
    keys = ["cohort", "metric", "comparator"]
    t = t_test(ref.unionByName(com), keys, "side", "value", "a", "b")
    t = holm(t, ["cohort", "metric"], "p", ["comparator"])
    return t.join(bootstrap.select(*keys, F.col("p_holm").alias("bootstrap_p_holm")), keys, "left")


def rank_agreement(Mt: DataFrame, pairs: Sequence[tuple[str, str]], config: str = "arm", cohort: str = "cohort",
                   value: str = "value") -> DataFrame:
    """Spearman correlation of a metric between cohorts over configurations (one row per configuration)."""
    w = Window.partitionBy(cohort).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(cohort, value))
    r = Mt.select(config, cohort, (F.rank().over(w) + (ties - 1) / 2.0).alias("r"))
    want = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]))
    left = r.withColumn("w", want).filter(F.col(cohort) == F.col("w.a")).select(
        config, F.col("w.a").alias("cohort_a"), F.col("w.b").alias("cohort_b"), F.col("r").alias("ra"))
    j = left.join(r.select(config, F.col(cohort).alias("cohort_b"), F.col("r").alias("rb")), [config, "cohort_b"])
    return j.groupBy("cohort_a", "cohort_b").agg(F.count(F.lit(1)).alias("configurations"),
                                                 F.corr("ra", "rb").alias("spearman_rho"))


def cohort_table(P: DataFrame) -> DataFrame:
    """Items, prevalence, arms and runs per cohort."""
    per_item = P.groupBy("cohort", "item_id").agg(F.max("y").alias("y"))
    a = per_item.groupBy("cohort").agg(F.count(F.lit(1)).alias("items"), F.sum("y").alias("positives"),
                                       F.avg(F.col("y").cast("double")).alias("prevalence"))
    runs = P.select("cohort", "arm", "seed").distinct().groupBy("cohort").agg(
        F.count(F.lit(1)).alias("runs"), F.countDistinct("arm").alias("arms"))
    return a.join(runs, "cohort")
