"""Shortcut and confounding audits: what a score owes to nuisance features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import hash_int, logit, ratio, sigmoid
from evalspark.operators import infer as B
from evalspark.operators import metrics as M
from evalspark.operators.curate import build_manifest
from evalspark.plans.fits import least_squares, linear, logistic
from evalspark.plans.groups import join_groups, join_skewed, rank_rows
from evalspark.plans.lineage import cut_lineage, stored
from evalspark.plans.prefix import exact_quantiles

FOLDS = 5


def masked_stats(G: DataFrame, by: Sequence[str], mask: Column, value: str, min_n: int, fallback: bool = True) -> DataFrame:
    """Mean and population sd of the masked rows of an item. With at most min_n of them the whole item is used
    (fallback), or, without fallback, fewer than min_n give NULL."""
    inside = F.when(mask, F.col(value))
    t = G.groupBy(*by).agg(F.count(inside).alias("n"), F.avg(inside).alias("m"), F.stddev_pop(inside).alias("s"),
                           F.avg(value).alias("m0"), F.stddev_pop(value).alias("s0"))
    if fallback:
        ok = F.col("n") > min_n
        return t.select(*by, "n", F.when(ok, F.col("m")).otherwise(F.col("m0")).alias("mean"),
                        F.when(ok, F.col("s")).otherwise(F.col("s0")).alias("sd"))
    ok = F.col("n") >= min_n
    return t.select(*by, "n", F.when(ok, F.col("m")).alias("mean"), F.when(ok, F.col("s")).alias("sd"))


def standardise(Fr: DataFrame, cols: Sequence[str], by: Sequence[str] = (), fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population sd per group, or with the moments of `fit`; a constant column becomes 0."""
    src = Fr if fit is None else fit
    aggs = [F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"__{c}") for c in cols]
    if by:
        d = join_groups(Fr, src.groupBy(*by).agg(*aggs), list(by))
        moment = {c: F.col(f"__{c}") for c in cols}
    else:
        one = src.agg(*aggs).select(F.struct(*[f"__{c}" for c in cols]).alias("__all")).select("__all").scalar()
        d = Fr.withColumn("__all", one)
        moment = {c: F.col("__all")[f"__{c}"] for c in cols}
    z = {c: (F.col(c) - moment[c]["m"]) / F.when(moment[c]["s"] > 0, moment[c]["s"]).otherwise(F.lit(1.0)) for c in cols}
    return d.withColumns(z).select(*Fr.columns)


def assign_folds(Fr: DataFrame, k: int = FOLDS, groups: str | None = None, by: Sequence[str] = (), label: str = "y",
                 item: str = "item_id", seed: int = 0) -> DataFrame:
    """`fold` per row. Grouped: whole groups, largest first, dealt in snake order. Otherwise stratified by hash rank."""
    by = list(by)
    if groups is None:
        r = rank_rows(Fr.withColumn("__h", hash_int(item, F.lit(seed))), [*by, label], ["__h", item], "__r")
        return r.withColumn("fold", ((F.col("__r") - 1) % k).cast("int")).drop("__r", "__h")
    g = Fr.groupBy(*by, groups).agg(F.count(F.lit(1)).alias("__n"))
    r = rank_rows(g, by, [F.col("__n").desc(), F.col(groups)], "__r")
    place, lap = (F.col("__r") - 1) % k, F.floor((F.col("__r") - 1) / k)
    fold = F.when(lap % 2 == 0, place).otherwise(k - 1 - place).cast("int")
    return join_skewed(Fr, r.select(*by, groups, "__n", fold.alias("fold")), [*by, groups], "__n")


def oof_scores(Fr: DataFrame, cols: Sequence[str], groups: str | None = None, by: Sequence[str] = (), y: str = "y",
               k: int = FOLDS) -> DataFrame:
    """Out-of-fold logistic scores `p` (C = 1). Every row trains the models of the other folds; all folds of all
    groups are fitted in the same passes."""
    by = list(by)
    d = cut_lineage(assign_folds(standardise(Fr, cols, by), k, groups, by, y))
    beta = logistic(d.select(*by, y, "fold", *cols), by, cols, y, fold="fold", folds=k)
    return d.join(beta.withColumnRenamed("model", "fold"), [*by, "fold"]).withColumn(
        "p", sigmoid(linear(F.col("beta"), cols))).drop("beta")


def cv_auc(Fr: DataFrame, cols: Sequence[str], groups: str | None = None, by: Sequence[str] = (), y: str = "y") -> DataFrame:
    return M.roc_auc(oof_scores(Fr, cols, groups, by, y), list(by), y=y, out="cv_auc")


def residual_scores(P: DataFrame, Fr: DataFrame, cols: Sequence[str], by: Sequence[str], item: str = "item_id") -> DataFrame:
    """Logit of the score and what is left of it after least squares on the features, per run. Labels play no part."""
    d = P.select(*by, item, "y", logit("p").alias("s")).join(Fr.select(item, *cols), item)
    beta = least_squares(d, by, cols, "s")
    return d.join(beta, list(by)).withColumn("residual", F.round(F.col("s") - linear(F.col("beta"), cols), 9)).drop("beta")


def _residual_summary(d: DataFrame, by: Sequence[str]) -> DataFrame:
    by = list(by)
    auc = M.roc_auc(M.to_long(d, [*by, "y"], ["s", "residual"], "which"), [*by, "which"])
    wide = auc.groupBy(*by).agg(F.max(F.when(F.col("which") == "s", F.col("roc_auc"))).alias("auc"),
                                F.max(F.when(F.col("which") == "residual", F.col("roc_auc"))).alias("auc_residual"))
    var = d.groupBy(*by).agg((1.0 - ratio(F.var_pop("residual"), F.var_pop("s"))).alias("r2"))
    return wide.join(var, by)


def residual_auc(P: DataFrame, Fr: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """AUC of the logit, AUC of its residual and the explained share of variance, per run."""
    return _residual_summary(residual_scores(P, Fr, cols, by), by)


def permutations(Fr: DataFrame, n: int, item: str = "item_id") -> DataFrame:
    """(perm, item, donor): n seeded permutations of the items, by rank of a hash within each permutation."""
    ids = Fr.select(item).distinct()
    base = rank_rows(ids, [], [item], "idx").select("idx", F.col(item).alias("donor"))
    d = ids.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("__h", hash_int(item, "perm"))
    return rank_rows(d, ["perm"], ["__h", item], "idx").join(base, "idx").select("perm", item, "donor")


def permutation_control(P: DataFrame, Fr: DataFrame, cols: Sequence[str], n: int, by: Sequence[str] = ("arm", "seed"),
                        over: str = "seed") -> DataFrame:
    """Drop of the residual AUC with the real features, and with the features shuffled across items: mean and the 95th
    percentile over permutations of the run mean."""
    by = list(by)
    arms = [b for b in by if b != over]
    perm = permutations(Fr, n)
    shuffled = perm.join(Fr.withColumnRenamed("item_id", "donor"), "donor").select("perm", "item_id", *cols)
    real = Fr.select(F.lit(-1).alias("perm"), "item_id", *cols)
    feats = cut_lineage(real.unionByName(shuffled))
    runs = ["perm", *by]
    d = P.select(*by, "item_id", "y", logit("p").alias("s")).join(feats, "item_id")
    beta = least_squares(d, runs, cols, "s")
    res = d.join(beta, runs).withColumn("residual", F.round(F.col("s") - linear(F.col("beta"), cols), 9))
    t = _residual_summary(res, runs).withColumn("drop", F.col("auc") - F.col("auc_residual"))
    per = t.groupBy(*arms, "perm").agg(F.avg("auc").alias("auc"), F.avg("auc_residual").alias("auc_residual"),
                                       F.avg("drop").alias("drop"), F.count(F.lit(1)).alias("runs"))
    is_real = F.col("perm") == -1
    return per.groupBy(*arms).agg(
        F.max("runs").alias("runs"), *[F.max(F.when(is_real, F.col(c))).alias(c) for c in ("auc", "auc_residual", "drop")],
        F.avg(F.when(~is_real, F.col("drop"))).alias("permutation_drop_mean"),
        F.percentile(F.when(~is_real, F.col("drop")), 0.95).alias("permutation_drop_p95"))


def control_score(Fr: DataFrame, cols: Sequence[str], groups: str | None = None) -> DataFrame:
    """Calibration point: the out-of-fold score of the features themselves through the same residual step."""
    s = oof_scores(Fr, cols, groups).select("item_id", "y", "p", F.lit("control").alias("arm"))
    return residual_auc(cut_lineage(s), standardise(Fr, cols), cols, ["arm"])


# --- swaps ---

def swap_shifts(S: DataFrame, swaps: Mapping[str, str], by: Sequence[str], item: str) -> DataFrame:
    """(by, kind, dp): mean over all pairs of a score after a swap and the same item's score before, then over the conditions
    of a kind. The pairs of an item are summed from its sums, in one aggregate: no row meets another in a join."""
    own, p = F.col("condition") == "original", F.col("p").cast("double")
    sign = F.when(F.col("y") == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    sums = [F.sum(F.when(own, p)).alias("__p"), F.count(F.when(own, p)).alias("__n")]
    for i, c in enumerate(swaps):
        at = (F.col("condition") == c) & p.isNotNull()
        sums += [F.sum(F.when(at, sign)).alias(f"__s{i}"), F.sum(F.when(at, sign * p)).alias(f"__t{i}"), F.count(F.when(at, 1)).alias(f"__n{i}")]
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (*by, item)])
    each = S.filter(known & F.col("condition").isin("original", *swaps)).groupBy(*by, item).agg(*sums)
    shift = [ratio(F.sum(F.col(f"__s{i}") * F.col("__p") - F.col("__n") * F.col(f"__t{i}")), F.sum(F.col(f"__n{i}") * F.col("__n")))
             .alias(f"__{i}") for i in range(len(swaps))]
    runs = each.groupBy(*by).agg(F.max("__n"), *shift)
    cells = F.array(F.struct(F.lit("original").alias("kind"), F.lit(None).cast("double").alias("dp")),
                    *[F.struct(F.lit(k).alias("kind"), F.col(f"__{i}").alias("dp")) for i, k in enumerate(swaps.values())])
    return runs.select(*by, F.explode(cells).alias("c")).groupBy(*by, F.col("c.kind").alias("kind")).agg(F.avg("c.dp").alias("dp"))


def swap_effects(S: DataFrame, by: Sequence[str] = ("cohort", "arm", "seed"), item: str = "item_id") -> DataFrame:
    """Per run: AUC of each condition (mean over donor draws), mean shift towards the other class, drops, and the
    class-specific effect same - other. The names of the conditions come out of the table of their AUCs."""
    by = list(by)
    kind = F.regexp_replace("condition", r"\d+$", "").alias("kind")
    per = stored(M.roc_auc(S, [*by, "condition"]), "conditions")
    swaps = per.select("condition", kind).filter(F.col("kind").isin("other", "same")).distinct().orderBy("condition").collect()
    auc = per.groupBy(*by, kind).agg(F.avg("roc_auc").alias("auc"))
    t = auc.join(swap_shifts(S, {r["condition"]: r["kind"] for r in swaps}, by, item), [*by, "kind"], "left")

    def pick(k: str, c: str) -> Column:
        return F.max(F.when(F.col("kind") == k, F.col(c)))

    w = t.groupBy(*by).agg(pick("original", "auc").alias("auc"), *[pick(k, "auc").alias(f"auc_{k}") for k in ("none", "other", "same")],
                           *[pick(k, "dp").alias(f"dp_towards_other_{k}") for k in ("other", "same")])
    return w.withColumns({"auc_drop_other": F.col("auc") - F.col("auc_other"), "auc_drop_same": F.col("auc") - F.col("auc_same"),
                          "class_specific_effect": F.col("auc_same") - F.col("auc_other")})


def swap_summary(E: DataFrame, pairs: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(t interval of the class-specific effect per arm; paired differences by seed, with a pooled row)."""
    keys = ["cohort"]
    arms = B.t_interval(E, [*keys, "arm"], "class_specific_effect")
    want = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]))
    left = E.withColumn("w", want).filter(F.col("arm") == F.col("w.a")).select(
        *keys, "seed", F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.col("class_specific_effect").alias("x"))
    right = E.select(*keys, "seed", F.col("arm").alias("b"), F.col("class_specific_effect").alias("z"))
    d = left.join(right, [*keys, "seed", "b"]).withColumn("d", F.col("z") - F.col("x"))
    names = F.explode(F.array(F.concat_ws(" - ", "b", "a"), F.lit("all pairs")))
    d = d.withColumn("pair", names)
    pos = d.groupBy(*keys, "pair").agg(F.concat(F.count(F.when(F.col("d") > 0, 1)).cast("string"), F.lit("/"),
                                                F.count(F.lit(1)).cast("string")).alias("positive"))
    return arms, B.t_interval(d, [*keys, "pair"], "d").join(pos, [*keys, "pair"])


# --- detector audits ---

def detector_features(items: DataFrame, I: DataFrame, item: str = "item_id") -> DataFrame:
    """Per item: detections, kept ones (all of them when the filter would empty the item), share filtered, mean kept
    radius and the fallback flags."""
    ok = F.col("keep")
    t = I.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("k"),
                            F.avg("r").alias("r_all"), F.avg(F.when(ok, F.col("r"))).alias("r_ok"))
    d = items.join(t, item, "left")
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    rest = [c for c in items.columns]
    return d.select(*rest, n.alias("n_detected"), F.when(k > 0, k).otherwise(n).alias("n_kept"),
                    F.when(n > 0, 1.0 - k / n).otherwise(F.lit(0.0)).alias("frac_filtered"),
                    F.coalesce(F.when(k > 0, F.col("r_ok")).otherwise(F.col("r_all")), F.lit(0.0)).alias("mean_radius"),
                    ((n > 0) & (k == 0)).cast("int").alias("fallback_kept_all"), (n == 0).cast("int").alias("scored_whole"))


def coverage(Fr: DataFrame, sets: Sequence[Column]) -> DataFrame:
    """Kept quartiles, medians, means and fallback counts for every class and then every subtype."""
    d = Fr.withColumn("subset", F.explode(F.array(*sets)))
    q = exact_quantiles(d, ["subset"], "n_kept", {"kept_q1": 0.25, "kept_median": 0.5, "kept_q3": 0.75})
    det = exact_quantiles(d, ["subset"], "n_detected", {"detected_median": 0.5})
    rad = exact_quantiles(d.withColumn("mean_radius", F.when(F.col("n_kept") > 0, F.col("mean_radius"))), ["subset"], "mean_radius",
                          {"radius_median": 0.5})
    a = d.groupBy("subset").agg(F.count(F.lit(1)).alias("items"), F.avg("frac_filtered").alias("frac_filtered"),
                                F.sum("fallback_kept_all").alias("fallback_kept_all"), F.sum("scored_whole").alias("scored_whole"))
    return reduce(lambda x, z: x.join(z, "subset", "left"), (q, det, rad), a)


def transfer_audit(Fr: DataFrame, source: str, fit_source: str, cols: Sequence[str], y: str = "y") -> DataFrame:
    """A rule fitted on one source and applied unchanged to every source: rows used, rows dropped for a missing feature
    and AUC; the fit source also out of fold. The features are written once: moments, fits, folds and scores read them."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    d = stored(Fr.withColumn("__ok", complete), "features")
    fit = d.filter(F.col("__ok") & (F.col(source) == fit_source))
    beta = logistic(standardise(fit, cols).withColumn("m", F.lit(0)), ["m"], cols, y)
    weights = F.array(*[F.lit(v) for v in beta.first()["beta"]])
    scored = standardise(d.filter("__ok"), cols, fit=fit).withColumn("p", sigmoid(linear(weights, cols)))
    auc = M.roc_auc(scored.withColumn("part", F.col(source)), ["part"], y=y)
    auc = auc.unionByName(cv_auc(fit, cols, y=y).select(F.lit(f"{fit_source} (cross-validated)").alias("part"),
                                                       F.col("cv_auc").alias("roc_auc")))
    n = d.groupBy(F.col(source).alias("part")).agg(F.count(F.when(F.col("__ok"), 1)).alias("n"),
                                                   F.count(F.when(~F.col("__ok"), 1)).alias("dropped"))
    return auc.join(n, "part", "left")


def instance_rule(I: DataFrame, labels: DataFrame, by: Sequence[str] = (), item: str = "item_id") -> DataFrame:
    """AUC of the item mean of an instance score."""
    m = I.groupBy(*by, item).agg(F.round(F.avg("p"), 12).alias("p")).join(labels.select(item, "y"), item)
    return M.roc_auc(m, list(by))


def pair_separability(Fr: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[str, str]], groups: str = "unit",
                      subtype: str = "subtype") -> DataFrame:
    """Grouped cross-validated AUC of the features for each listed pair of subtypes (first negative)."""
    want = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]))
    d = Fr.withColumn("w", want).filter(F.col(subtype).isin(F.col("w.a"), F.col("w.b")))
    d = d.select("item_id", groups, *cols, F.concat_ws(" vs ", "w.a", "w.b").alias("pair"),
                 (F.col(subtype) == F.col("w.b")).cast("int").alias("y"))
    n = d.groupBy("pair").agg(F.count(F.lit(1)).alias("items"), F.countDistinct(groups).alias("groups"))
    return cv_auc(d, cols, groups, ["pair"]).join(n, "pair")


def linear_probe(train: DataFrame, val: DataFrame, cols: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """Penalty by validation AUC (class-balanced weights, smaller C on ties). All penalties are fitted together."""
    counts = train.groupBy("y").agg(F.count(F.lit(1)).alias("__n"))
    total = train.agg(F.count(F.lit(1)).alias("t")).select("t").scalar()
    w = counts.select("y", (total / (2.0 * F.col("__n"))).alias("w"))
    each = F.explode(F.array(*[F.lit(float(c)) for c in grid]))
    z = join_groups(standardise(train, cols), w, ["y"]).withColumn("c", each)
    beta = logistic(z, ["c"], cols, c="c", weight="w")
    s = standardise(val, cols, fit=train).withColumn("c", each).join(beta, "c").withColumn(
        "p", sigmoid(linear(F.col("beta"), cols)))
    auc = M.roc_auc(s, ["c"], out="val_auc")
    top = auc.agg(F.max_by("c", F.struct("val_auc", -F.col("c"))).alias("c")).select("c").scalar()
    return auc.withColumn("chosen", F.col("c") == top)


def frame_scale(boxes: DataFrame, size: int = 640, squeezed: float = 0.60) -> DataFrame:
    """The squeeze factor of a source: only when every frame has the squeezed format."""
    every = F.bool_and((F.col("img_w") == size) & (F.col("img_h") == size))
    return boxes.agg(F.when(every, F.lit(squeezed)).otherwise(F.lit(1.0)).alias("x_scale"))


def replicate_cohort(raw: DataFrame, same: DataFrame, mapping: Mapping[str, int], opposing: Mapping[int, Sequence[str]], **kw) -> DataFrame:
    """The replicate's manifest: the chain of the first cohort, with the squeeze factor that its own frames ask for."""
    return build_manifest(raw, same, mapping, opposing, x_scale=frame_scale(raw).first()["x_scale"], **kw)


def replicate_audit(d: DataFrame, Fr: DataFrame, cols: Sequence[str], groups: str | None = "unit") -> dict[str, DataFrame]:
    """Residual AUC of every run, and the grouped cross-validated AUC of the features alone."""
    z = cut_lineage(standardise(Fr, cols))
    return {"residual": residual_auc(d, z, cols, ["arm", "seed"]), "background": cv_auc(z, cols, groups)}


def replicate(P: DataFrame, cohort: str, reference: str, comparators: Sequence[str], n_boot: int, n_boot_runs: int = 200,
              Fr: DataFrame | None = None, cols: Sequence[str] = (), groups: str | None = "unit") -> dict[str, DataFrame]:
    """The pre-specified replicate on another source, nothing tuned on it: metrics of every run with the interval of its
    AUC (`runs`), their means per arm (`summary`), the tests of the reference against each comparator (`tests`) and,
    with features, `residual` and `background` of `replicate_audit`."""
    d = P.filter(F.col("cohort") == cohort)
    runs = B.run_bundle(d, n_boot_runs)
    means = ("roc_auc", "average_precision", "macro_f1", "positive_rate", "ece")
    out = {"runs": runs,
           "summary": runs.groupBy("arm").agg(F.count(F.lit(1)).alias("seeds"), F.stddev_samp("roc_auc").alias("roc_auc_sd"),
                                              *[F.avg(c).alias(c) for c in means]),
           "tests": B.method_tests(d.filter(F.col("arm").isin(reference, *comparators)), reference, comparators, n_boot)}
    return out if Fr is None else out | replicate_audit(d, Fr, cols, groups)
