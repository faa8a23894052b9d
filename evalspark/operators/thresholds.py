"""Decision thresholds and recalibration: Youden, prior shift by EM, temperature scaling, metrics at several rules."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import finite, logit, sigmoid
from evalspark.operators import metrics as M
from evalspark.plans.lineage import stored

LOG_T_BOUND = 5.0
RULES = (0.5, "val_youden", "prior_shift")
STEPS_A_JOB = 4


def youden(P: DataFrame, by: Sequence[str], out: str = "threshold") -> DataFrame:
    """Threshold of the largest sensitivity + specificity - 1; the highest one on ties, at most 1.0. The starting
    point of the curve (nothing positive, J = 0) takes part with an infinite threshold."""
    c = M._descending(M.score_histogram(P, by), by)
    j = F.col("tp").cast("double") * F.col("n_neg") - F.col("fp").cast("double") * F.col("n_pos")
    best = c.groupBy(*by).agg(F.max(F.struct(j.alias("j"), F.col("p"))).alias("b"), F.max("n_pos").alias("np"),
                              F.max("n_neg").alias("nn"))
    t = F.when(F.col("b.j") <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("b.p")))
    return best.select(*by, F.when((F.col("np") > 0) & (F.col("nn") > 0), t).alias(out))


def _histogram(P: DataFrame, by: Sequence[str]) -> DataFrame:
    h = P.filter(finite("p")).groupBy(*by, "p").agg(F.count(F.lit(1)).alias("n"))
    return h.persist()


def prior_shift(P: DataFrame, by: Sequence[str], train_prior: float = 0.5, iters: int = 1000, tol: float = 1e-6,
                out: str = "threshold") -> DataFrame:
    """Label-free threshold: the positive prior is re-estimated by EM on the unlabelled scores.

    All runs advance together, one aggregate over the score histogram per step; the estimates are a table, written every
    STEPS_A_JOB steps. A run whose estimate moved less than `tol` is frozen before that step's update and leaves the
    next job. `converged` is False for a run whose estimate still moved after `iters` steps.
    """
    by = list(by)
    hist = _histogram(P, by)
    state = stored(hist.select(*by).distinct().withColumns({"pi": F.lit(float(train_prior)), "moving": F.lit(True)}))

    def step(s: DataFrame) -> DataFrame:
        up = F.col("p") * F.col("pi") / train_prior
        q = up / (up + (1.0 - F.col("p")) * (1.0 - F.col("pi")) / (1.0 - train_prior))
        t = hist.join(s, by).groupBy(*by).agg((F.sum(q * F.col("n")) / F.sum("n")).alias("q"), F.first("pi").alias("pi"),
                                              F.first("moving").alias("moving"))
        moving = F.col("moving") & F.col("q").isNotNull() & (F.abs(F.col("q") - F.col("pi")) >= tol)
        return t.select(*by, F.when(moving, F.col("q")).otherwise(F.col("pi")).alias("pi"), F.coalesce(moving, F.lit(False)).alias("moving"))

    done = 0
    while done < iters and not state.filter("moving").isEmpty():
        new = state.filter("moving")
        for _ in range(min(STEPS_A_JOB, iters - done)):
            new = step(new)
        state = stored(state.filter("NOT moving").unionByName(new))
        done += STEPS_A_JOB
    hist.unpersist()
    prior = train_prior / (1 - train_prior)
    odds = (1.0 - F.col("pi")) / F.col("pi") * prior
    return state.select(*by, F.col("pi").alias("prior"), F.when(F.col("pi") > 0, odds / (1.0 + odds)).otherwise(F.lit(1.0)).alias(out),
                        (~F.col("moving")).alias("converged"))


def _constant(P: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    return P.groupBy(*keys).agg(F.lit(cutoff).alias("threshold"))


def _from_validation(P: DataFrame, keys: list[str], cohort: str, validation: str) -> DataFrame:
    shared = [k for k in keys if k != cohort]
    chosen = youden(P.where(F.col(cohort) == validation), shared)
    return P.groupBy(*keys).agg(F.lit(1).alias("__run")).join(chosen, shared).select(*keys, "threshold")


def resolve_threshold(P: DataFrame, rule, keys: Sequence[str] = ("cohort", "arm", "seed"),
                      cohort: str = "cohort", validation: str = "val") -> DataFrame:
    """One threshold per run: a number, or the rule of a name: `val_youden` takes it from the same arm and seed on the
    validation cohort, `prior_shift` from the unlabelled scores."""
    named = {"val_youden": lambda: _from_validation(P, list(keys), cohort, validation),
             "prior_shift": lambda: prior_shift(P, keys).select(*keys, "threshold")}
    make = named.get(rule) if isinstance(rule, str) else lambda: _constant(P, list(keys), float(rule))
    if make is None:
        raise ValueError(f"unknown rule {rule!r}; known are numbers and {', '.join(named)}")
    return make()


def metrics_at_rules(P: DataFrame, rules: Sequence = RULES, keys: Sequence[str] = ("cohort", "arm", "seed"),
                     validation: str = "val") -> DataFrame:
    """Decision metrics of every run at every rule, from the scores and never from a stored decision."""
    keys = list(keys)
    t = None
    for rule in rules:
        one = resolve_threshold(P, rule, keys, validation=validation).withColumn("rule", F.lit(str(rule)))
        t = one if t is None else t.unionByName(one)
    # thresholds become one small map per run, so each score row is read once for all rules
    per_run = t.groupBy(*keys).agg(F.collect_list(F.struct("rule", "threshold")).alias("rules"))
    hist = M.score_histogram(P, keys).filter("bad = 0")
    d = hist.join(per_run, keys).select(*keys, "p", "pos", "neg", F.explode("rules").alias("r"))
    hit = F.col("p") >= F.col("r.threshold")
    cm = d.groupBy(*keys, F.col("r.rule").alias("rule"), F.col("r.threshold").alias("threshold")).agg(
        F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("n_0_0"), F.sum(F.when(hit, F.col("neg")).otherwise(0))
        .alias("n_0_1"), F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("n_1_0"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("n_1_1"))
    by = [*keys, "rule", "threshold"]
    f1 = M._threshold_values(cm, by, (0, 1)).select(*by, "macro_f1")
    return M._decision_values(cm, by).join(f1, by)


def rule_report(P: DataFrame, rules: Sequence = RULES, validation: str = "val") -> DataFrame:
    """Mean and sd over seeds at every rule, with the count of one-class runs."""
    names = ("threshold", "balanced_accuracy", "sensitivity", "specificity", "mcc", "positive_rate")
    m = metrics_at_rules(P, rules, validation=validation)
    return m.groupBy("cohort", "arm", "rule").agg(
        F.count(F.lit(1)).alias("seeds"), *[F.avg(n).alias(n) for n in names],
        *[F.stddev_samp(n).alias(f"{n}_sd") for n in names],
        F.concat(F.count(F.when(F.col("degenerate"), 1)).cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string"))
        .alias("degenerate_runs"))


def fit_temperature(P: DataFrame, by: Sequence[str], bound: float = LOG_T_BOUND, points: int = 15,
                    tol: float = 1e-7) -> DataFrame:
    """The T > 0 that minimises the likelihood loss of sigmoid(logit(p) / T), |log T| <= bound.

    The loss is convex in 1 / T, hence has one minimum in log T. Every pass evaluates an even grid inside the bracket
    of each run with one aggregate over the score histogram, and the bracket shrinks to the neighbours of the best.
    """
    by = list(by)
    hist = M.score_histogram(P, by).filter("bad = 0").persist()
    z = logit("p")
    last = points + 1

    def step(s: DataFrame) -> DataFrame:
        grid = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / last)

        def loss(i: int):
            x = z / F.exp(F.get("grid", F.lit(i)))
            soft = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
            return F.sum(F.col("pos") * (soft - x) + F.col("neg") * soft)

        t = hist.join(s.select(*by, grid.alias("grid")), by).groupBy(*by).agg(
            F.array(*[loss(i) for i in range(last + 1)]).alias("losses"), F.first("grid").alias("grid"))
        best = F.array_position("losses", F.array_min("losses")).cast("int") - 1
        return t.select(*by, F.get("grid", F.greatest(best - 1, F.lit(0))).alias("lo"), F.get("grid", F.least(best + 1, F.lit(last))).alias("hi"))

    # every pass leaves at most two of the points + 1 gaps, so their number is known beforehand
    passes = math.ceil(math.log(2 * bound / tol) / math.log(last / 2))
    state = stored(hist.select(*by).distinct().withColumns({"lo": F.lit(-float(bound)), "hi": F.lit(float(bound))}))
    for at in range(0, passes, STEPS_A_JOB):
        for _ in range(min(STEPS_A_JOB, passes - at)):
            state = step(state)
        state = stored(state)
    hist.unpersist()
    middle = (F.col("lo") + F.col("hi")) / 2
    return state.select(*by, F.exp(middle).alias("temperature"), (middle > bound - 1e-3).alias("at_bound"))


def temperature_report(P: DataFrame, validation: str = "val") -> DataFrame:
    """Brier, skill and ECE before and after the temperature fitted on the same run's validation scores, seed means."""
    run, keys = ["arm", "seed"], ["cohort", "arm", "seed"]
    t = fit_temperature(P.filter(F.col("cohort") == validation), run)
    out = t.select(*run, "temperature", "at_bound")
    both = P.join(out, run).select(*keys, "y", F.explode(F.array(
        F.struct(F.lit("before").alias("stage"), F.col("p").alias("p")),
        F.struct(F.lit("after").alias("stage"), sigmoid(logit("p") / F.col("temperature")).alias("p")))).alias("s"))
    both = both.select(*keys, "y", "s.*")
    m = M.brier(both, [*keys, "stage"]).join(M.ece(both, [*keys, "stage"]), [*keys, "stage"]).join(out, run)
    stages = [F.avg(F.when(F.col("stage") == s, F.col(c))).alias(f"{c}_{s}") for s in ("before", "after")
              for c in ("brier", "brier_skill", "ece")]
    return m.groupBy("cohort", "arm").agg(
        F.countDistinct("seed").alias("seeds"), F.avg("temperature").alias("temperature"),
        F.min("temperature").alias("temperature_min"), F.max("temperature").alias("temperature_max"),
        F.count(F.when(F.col("at_bound") & (F.col("stage") == "after"), 1)).alias("at_bound"), *stages)


def logits(P: DataFrame) -> DataFrame:
    return P.withColumn("z", logit("p"))

