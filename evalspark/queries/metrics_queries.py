"""Metrics over the prediction view."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.columns import round6
from evalspark.operators import metrics as M
from evalspark.queries.oracle import bin_sql, sql
from evalspark.sources import views as V

RUN = ["cohort", "arm", "seed"]
R = "cohort, arm, seed"


def rounded(df, keep=()):
    """Round every double, so that the order of a float sum cannot show."""
    return df.select(*[round6(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def fine(df):
    """Round every double at 12 places, where a quotient of exact sums cannot end in a tie."""
    return df.select(*[F.round(c, 12).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


P = V.prediction
CM = f"""SELECT {R}, count(*) FILTER (y=0 AND pred=0) AS n_0_0, count(*) FILTER (y=0 AND pred=1) AS n_0_1,
 count(*) FILTER (y=1 AND pred=0) AS n_1_0, count(*) FILTER (y=1 AND pred=1) AS n_1_1 FROM pred GROUP BY ALL"""
PRED = "SELECT *, (p >= 0.5::DOUBLE)::INT AS pred FROM prediction"
AUC = """SELECT {k}, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN
 (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)::DOUBLE) END AS {out}
 FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY {k}, {p}) - 1) / 2.0::DOUBLE AS rk
       FROM {src} WINDOW w AS (PARTITION BY {k} ORDER BY {p})) GROUP BY {k}"""


def auc_sql(k: str = R, src: str = "prediction", p: str = "p", out: str = "roc_auc") -> str:
    return AUC.format(k=k, src=src, p=p, out=out)


CURVE = f"""SELECT {R}, p AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {R}) AS np,
 sum(neg) OVER (PARTITION BY {R}) AS nn, pos FROM (SELECT {R}, p, sum(y) AS pos, sum(1 - y) AS neg FROM prediction GROUP BY ALL)
 WINDOW w AS (PARTITION BY {R} ORDER BY p DESC)"""
AP = f"SELECT {R}, sum(pos * tp / (tp + fp)::DOUBLE) / max(np) AS average_precision FROM curve GROUP BY ALL"
BINS = f"SELECT {R}, {bin_sql('p')} AS bin, count(*) AS n, sum(p::DECIMAL(18, 9))::DOUBLE AS sp, sum(y) AS sy FROM prediction GROUP BY ALL"
F1 = "(coalesce(2.0*n_1_1/nullif(2*n_1_1+n_1_0+n_0_1,0),0) + coalesce(2.0*n_0_0/nullif(2*n_0_0+n_1_0+n_0_1,0),0)) / 2"
DEC = f"""SELECT {R}, n_1_1/(n_1_1+n_1_0) AS sensitivity, n_0_0/(n_0_0+n_0_1) AS specificity,
 CASE WHEN (n_1_1+n_0_1)*(n_1_1+n_1_0)*(n_0_0+n_0_1)*(n_0_0+n_1_0) > 0 THEN (n_1_1*n_0_0 - n_0_1*n_1_0)::DOUBLE /
  (sqrt(n_1_1+n_0_1)*sqrt(n_1_1+n_1_0)*sqrt(n_0_0+n_0_1)*sqrt(n_0_0+n_1_0)) ELSE 0.0 END AS mcc,
 (n_1_1+n_0_1)/(n_1_1+n_0_1+n_0_0+n_1_0) AS positive_rate FROM cm"""
CTE = dict(pred=PRED, cm=CM, curve=CURVE, ap=AP, bins=BINS, dec=DEC, auc=auc_sql())

Q = {}


def leaderboard(spark, d):
    p = P(spark, d)
    runs = M.ranking_metrics(p, RUN)
    return rounded(M.seed_summary(runs, ["cohort", "arm"], ["roc_auc", "average_precision", "brier"])
                   .drop("roc_auc_positive", "average_precision_positive", "brier_positive"))


Q["leaderboard"] = (leaderboard, sql(f"""
SELECT cohort, arm, count(*) AS seeds, {", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_sd"
                                               for m in ("roc_auc", "average_precision", "brier"))}
FROM auc JOIN ap USING ({R}) JOIN br USING ({R}) GROUP BY ALL""",
    br=f"SELECT {R}, avg((p - y) * (p - y)) AS brier FROM prediction GROUP BY ALL", **CTE))

Q["k01_decide"] = (
    lambda s, d: M.decide(P(s, d)).groupBy(*RUN, "y", "pred").agg(F.count(F.lit(1)).alias("n")),
    sql(f"SELECT {R}, y, pred, count(*) AS n FROM pred GROUP BY ALL", **CTE))
Q["k02_confusion"] = (lambda s, d: M.confusion(M.decide(P(s, d)), RUN), sql(f"SELECT * FROM cm", **CTE))
Q["k03_accuracy_kappa"] = (
    lambda s, d: rounded(M.threshold_metrics(M.decide(P(s, d)), RUN)
                         .select(*RUN, "accuracy", "balanced_accuracy", "kappa")),
    sql(f"""SELECT {R}, round((n_0_0+n_1_1)/n, 6) AS accuracy, round((n_1_1/(n_1_1+n_1_0) + n_0_0/(n_0_0+n_0_1))/2, 6)
 AS balanced_accuracy, round(((n_0_0+n_1_1)/n - e)/(1-e), 6) AS kappa FROM (SELECT *,
 ((n_0_0+n_0_1)*(n_0_0+n_1_0)+(n_1_0+n_1_1)*(n_0_1+n_1_1))/(n*n) AS e FROM (SELECT *, (n_0_0+n_0_1+n_1_0+n_1_1)::DOUBLE
 AS n FROM cm))""", **CTE))
Q["k04_precision_recall_f1"] = (
    lambda s, d: rounded(M.threshold_metrics(M.decide(P(s, d)), RUN).select(
        *RUN, "macro_precision", "macro_recall", "macro_f1", "precision_0", "precision_1", "recall_0", "recall_1",
        "f1_0", "f1_1")),
    sql(f"""SELECT {R}, round((p0+p1)/2, 6) AS macro_precision, round((r0+r1)/2, 6) AS macro_recall, round((f0+f1)/2, 6) AS macro_f1,
 round(p0,6) AS precision_0, round(p1,6) AS precision_1, round(r0,6) AS recall_0, round(r1,6) AS recall_1, round(f0,6) AS f1_0,
 round(f1,6) AS f1_1 FROM (SELECT {R}, coalesce(n_0_0/nullif(n_0_0+n_1_0,0),0.0) AS p0, coalesce(n_1_1/nullif(n_1_1+n_0_1,0),0.0)
 AS p1, n_0_0/(n_0_0+n_0_1) AS r0, n_1_1/(n_1_1+n_1_0) AS r1, 2*n_0_0/(2*n_0_0+n_0_1+n_1_0) AS f0,
 2*n_1_1/(2*n_1_1+n_0_1+n_1_0) AS f1 FROM cm)""", **CTE))
Q["k05_specificity"] = (
    lambda s, d: rounded(M.threshold_metrics(M.decide(P(s, d)), RUN).select(
        *RUN, "macro_specificity", "specificity_0", "specificity_1")),
    sql(f"""SELECT {R}, round((a+b)/2, 6) AS macro_specificity, round(a, 6) AS specificity_0, round(b, 6) AS specificity_1
 FROM (SELECT {R}, n_1_1/(n_1_1+n_1_0) AS a, n_0_0/(n_0_0+n_0_1) AS b FROM cm)""", **CTE))
Q["k06_macro_f1_present"] = (
    lambda s, d: rounded(M.macro_f1_present(M.decide(P(s, d), 0.97), RUN)),
    sql(f"""SELECT {R}, round((f0 + f1) / 2, 6) AS macro_f1 FROM (SELECT {R},
 2*count(*) FILTER (y=0 AND pr=0)/(count(*) FILTER (y=0) + count(*) FILTER (pr=0)) AS f0,
 2*count(*) FILTER (y=1 AND pr=1)/(count(*) FILTER (y=1) + count(*) FILTER (pr=1)) AS f1
 FROM (SELECT *, (p >= 0.97::DOUBLE)::INT AS pr FROM prediction) GROUP BY ALL)"""))
Q["k07_decision_values"] = (
    lambda s, d: rounded(M.decision_values(M.decide(P(s, d)), RUN)),
    sql(f"""SELECT {R}, round((sensitivity+specificity)/2,6) AS balanced_accuracy, round(sensitivity,6) AS sensitivity,
 round(specificity,6) AS specificity, round(mcc,6) AS mcc, round(positive_rate,6) AS positive_rate,
 positive_rate >= 0.95::DOUBLE OR positive_rate <= 0.05::DOUBLE AS degenerate FROM dec""", **CTE))
Q["k08_roc_auc"] = (lambda s, d: rounded(M.roc_auc(P(s, d), RUN)),
                    sql(f"SELECT {R}, round(roc_auc, 6) AS roc_auc FROM auc", **CTE))
Q["k09_average_precision"] = (
    lambda s, d: rounded(M.average_precision(P(s, d), RUN)),
    sql(f"SELECT {R}, round(average_precision, 6) AS average_precision FROM ap", **CTE))
Q["k10_roc_curve"] = (
    lambda s, d: rounded(M.roc_curve(P(s, d), RUN)),
    sql(f"""SELECT {R}, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(fp/nn, 6) AS fpr, round(tp/np, 6) AS tpr
 FROM curve""", **CTE))
Q["k11_sens_at_spec"] = (
    lambda s, d: rounded(M.sens_at_spec(P(s, d), RUN, 0.9)),
    sql(f"""SELECT {R}, round(coalesce(max(tp/np) FILTER (fp/nn <= 0.1::DOUBLE + 1e-9::DOUBLE), 0.0), 6) AS sens_at_spec FROM curve
 GROUP BY ALL""", **CTE))
Q["k12_brier"] = (
    lambda s, d: rounded(M.brier(P(s, d), RUN)),
    sql(f"""SELECT {R}, round(b, 6) AS brier, round(m, 6) AS prevalence, round(1 - b/(m*(1-m)), 6) AS brier_skill FROM (SELECT {R},
 avg((p-y)*(p-y)) AS b, avg(y) AS m FROM prediction GROUP BY ALL)"""))
Q["k13_ece"] = (
    lambda s, d: rounded(M.ece(P(s, d), RUN)),
    sql(f"SELECT {R}, round(sum(abs(sy - sp)) / sum(n), 6) AS ece FROM bins GROUP BY ALL", **CTE))
Q["k14_reliability"] = (
    lambda s, d: fine(M.reliability(P(s, d), RUN, 40)),
    sql(f"""SELECT {R}, bin, round(bin/40.0, 12)::DOUBLE AS bin_low, round((bin+1)/40.0, 12)::DOUBLE AS bin_high,
 round(sp/n, 12) AS mean_p, round(sy/n, 12) AS fraction_positive, coalesce(n, 0) AS count
 FROM (SELECT * FROM (SELECT DISTINCT {R} FROM b2), (SELECT unnest(range(40))::INT AS bin)) LEFT JOIN b2 USING ({R}, bin)""",
        b2=BINS.replace(bin_sql("p"), bin_sql("p", 40))))
Q["k15_diagnostics"] = (
    lambda s, d: rounded(M.diagnostics(M.decide(P(s, d), 0.96), RUN)),
    sql(f"""SELECT {R}, round(r,6) AS positive_rate, round(a,6) AS mean_p_on_negatives, round(b,6) AS mean_p_on_positives,
 r >= 0.95::DOUBLE OR r <= 1 - 0.95::DOUBLE AS degenerate FROM (SELECT {R}, avg((p >= 0.96::DOUBLE)::INT) AS r, avg(p) FILTER (y=0)
 AS a, avg(p) FILTER (y=1) AS b FROM prediction GROUP BY ALL)"""))
Q["k16_degeneracy"] = (
    lambda s, d: rounded(M.degeneracy(M.decide(P(s, d), 0.96), RUN)),
    sql(f"""SELECT {R}, CASE WHEN r > 0.5 THEN 1 ELSE 0 END AS dominant, round(greatest(r, 1-r), 6) AS rate,
 CASE WHEN greatest(r, 1-r) >= 0.95::DOUBLE THEN 'degenerate' ELSE '' END AS note FROM
 (SELECT {R}, avg((p >= 0.96::DOUBLE)::INT) AS r FROM prediction GROUP BY ALL)"""))
Q["k17_average_precision_negative"] = (
    lambda s, d: rounded(M.average_precision(P(s, d), RUN, positive=0, out="auprc_negative")),
    sql(f"""SELECT {R}, round(sum(neg * tn / (tn + fn)::DOUBLE) / sum(neg), 6) AS auprc_negative FROM (
 SELECT {R}, neg, sum(neg) OVER w AS tn, sum(pos) OVER w AS fn FROM (SELECT {R}, p, sum(y) AS pos, sum(1 - y) AS neg
 FROM prediction GROUP BY ALL) WINDOW w AS (PARTITION BY {R} ORDER BY p)) GROUP BY ALL"""))
Q["k18_auc_vs_reference"] = (
    lambda s, d: rounded(M.auc_vs_reference(P(s, d), RUN, "subtype", "base")),
    sql(f"""SELECT {R}, subtype, n_pos, n_neg, round(roc_auc, 6) AS roc_auc FROM subauc JOIN subcnt USING ({R}, subtype)""",
        ext=f"""SELECT {R}, y, p, s.subtype FROM prediction p JOIN (SELECT DISTINCT subtype FROM prediction WHERE
 subtype <> 'base') s ON p.subtype = s.subtype OR p.subtype = 'base'""",
        subauc=auc_sql(f"{R}, subtype", "ext"),
        subcnt=f"SELECT {R}, subtype, sum(y)::BIGINT AS n_pos, sum(1-y)::BIGINT AS n_neg FROM ext GROUP BY ALL"))
Q["k19_subset_median"] = (
    lambda s, d: rounded(M.subset_median(P(s, d), ["cohort", "arm"], F.col("subtype") == "base")),
    sql("""SELECT cohort, arm, round(avg(m), 6) AS median_p FROM (SELECT cohort, arm, seed, quantile_cont(p, 0.5) AS m
 FROM prediction WHERE subtype = 'base' GROUP BY ALL) GROUP BY ALL"""))
Q["k20_feature_auc"] = (
    lambda s, d: rounded(M.feature_auc(V.features(s, d), ["f1", "f2", "f3"])),
    sql("SELECT feature, round(roc_auc, 6) AS roc_auc, round(abs(roc_auc - 0.5), 6) AS distance FROM fa",
        fl=" UNION ALL ".join(f"SELECT '{f}' AS feature, y, {f} AS p FROM features" for f in ("f1", "f2", "f3")),
        fa=auc_sql("feature", "fl")))
BUNDLE = f"""SELECT {R}, round(roc_auc,6) AS roc_auc, round(average_precision,6) AS average_precision, round(prevalence,6) AS prevalence,
 round(brier,6) AS brier, round(s90,6) AS sens_at_spec90, round(s95,6) AS sens_at_spec95, round(ece,6) AS ece,
 round((sensitivity+specificity)/2,6) AS balanced_accuracy, round(sensitivity,6) AS sensitivity, round(specificity,6) AS specificity,
 round(mcc,6) AS mcc, round(positive_rate,6) AS positive_rate, round({F1},6) AS macro_f1,
 round((n_0_0+n_1_1)/(n_0_0+n_1_1+n_0_1+n_1_0),6) AS accuracy
 FROM auc JOIN ap USING ({R}) JOIN dec USING ({R}) JOIN cm USING ({R}) JOIN
 (SELECT {R}, avg(y) AS prevalence, avg((p-y)*(p-y)) AS brier FROM prediction GROUP BY ALL) USING ({R}) JOIN
 (SELECT {R}, coalesce(max(tp/np) FILTER (fp/nn <= 0.1::DOUBLE + 1e-9), 0.0) AS s90, coalesce(max(tp/np) FILTER (fp/nn <= 0.05::DOUBLE
  + 1e-9), 0.0) AS s95 FROM curve GROUP BY ALL) USING ({R}) JOIN
 (SELECT {R}, sum(abs(sy - sp)) / sum(n) AS ece FROM bins GROUP BY ALL) USING ({R})"""
Q["k21_cohort_metrics"] = (lambda s, d: rounded(M.cohort_metrics(P(s, d), RUN)), sql(BUNDLE, **CTE))
Q["k22_family_score"] = (
    lambda s, d: rounded(M.family_score(P(s, d), ["cohort", "seed"], "arm", ["jitter", "blend", "plain"])),
    sql(f"""SELECT cohort, seed, round(avg(0.5::DOUBLE*roc_auc + 0.5::DOUBLE*({F1})), 6) AS score_j FROM auc JOIN cm USING ({R})
 WHERE arm IN ('jitter', 'blend', 'plain') GROUP BY ALL""", **CTE))
Q["k22_family_metrics"] = (
    lambda s, d: rounded(M.family_metrics(P(s, d), ["cohort", "seed"], "arm")),
    sql(f"""SELECT {R}, round(roc_auc,6) AS roc_auc, round({F1},6) AS macro_f1, round(positive_rate,6) AS positive_rate
 FROM auc JOIN cm USING ({R}) JOIN dec USING ({R})""", **CTE))
Q["k23_nll"] = (
    lambda s, d: rounded(M.nll(P(s, d).withColumn("w", F.when(F.col("y") == 1, 2.0).otherwise(1.0)), RUN, "w")),
    sql(f"""SELECT {R}, round(sum(-ln(greatest(CASE WHEN y=1 THEN p ELSE 1-p END, 1e-12::DOUBLE)) * (1+y)) / sum(1+y), 6) AS nll
 FROM prediction GROUP BY ALL"""))
Q["k24_localisation"] = (
    lambda s, d: rounded(M.localisation(V.heat_grid(s, d), ["item_id"])),
    sql("""SELECT item_id, mx <> 0 AND pm > 0 AS peak_in_mask, CASE WHEN total < 1e-8 THEN 0.0 ELSE
 round(least(100.0, im / total * 100), 6) END AS energy_in_mask, coalesce(round(100.0::DOUBLE * inter / nullif(uni, 0), 6), 100.0)
 AS iou FROM (SELECT item_id, max(heat) AS mx, arg_max(mask, (heat, -row, -col)) AS pm, sum(heat) AS total,
 sum(heat) FILTER (mask > 0) AS im, count(*) FILTER (heat >= 0.45::DOUBLE AND mask > 0) AS inter,
 count(*) FILTER (heat >= 0.45::DOUBLE OR mask > 0) AS uni FROM heat_grid GROUP BY item_id)"""))
Q["k25_drop_increase"] = (
    lambda s, d: rounded(M.drop_increase(
        V.swap_scores(s, d).filter("condition = 'original'"), V.swap_scores(s, d).filter("condition = 'none'"),
        [*RUN, "item_id"], RUN)),
    sql(f"""SELECT {R}, round(avg(CASE WHEN a.p <= 1e-8 THEN 0.0 ELSE greatest(0.0, (a.p - b.p) / a.p) * 100 END), 6) AS average_drop,
 round(avg((b.p > a.p)::INT) * 100, 6) AS increase_rate FROM (SELECT * FROM swap_scores WHERE condition = 'original') a
 JOIN (SELECT * FROM swap_scores WHERE condition = 'none') b USING ({R}, item_id) GROUP BY ALL"""))


def batch_means(s, d):
    b = P(s, d).groupBy(*RUN, "unit").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"))
    return rounded(M.weighted_mean(b, RUN, "n", ["p"]))


Q["k26_weighted_mean"] = (batch_means, sql(f"SELECT {R}, round(avg(p), 6) AS p FROM prediction GROUP BY ALL"))
