"""Thresholds, recalibration and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.columns import logit
from evalspark.operators import fuse as U_
from evalspark.operators import metrics as M
from evalspark.operators import thresholds as T
from evalspark.queries.metrics_queries import CTE, F1, RUN, R, auc_sql, rounded
from evalspark.queries.oracle import bin_sql, sql
from evalspark.sources import views as V

P, I = V.prediction, V.instance_runs
Q = {}

YOUDEN = f"""SELECT {R}, CASE WHEN j <= 0 THEN 1.0 ELSE least(1.0, t) END AS threshold FROM (
 SELECT {R}, max(tp*nn - fp*np) AS j, arg_max(threshold, (tp*nn - fp*np, threshold)) AS t FROM curve GROUP BY ALL)"""
HIST = f"""SELECT {R}, list(p ORDER BY p) AS ps, list(n::DOUBLE ORDER BY p) AS ns, sum(n) AS tot FROM
 (SELECT {R}, p, count(*) AS n FROM prediction GROUP BY ALL) GROUP BY ALL"""
QBAR = """list_sum(list_transform(range(1, len(ps) + 1), lambda i: ns[i] * (ps[i]*{pi}/0.5::DOUBLE) / (ps[i]*{pi}/0.5::DOUBLE
 + (1.0::DOUBLE-ps[i])*(1.0::DOUBLE-{pi})/0.5::DOUBLE))) / tot"""
EM = f"""SELECT {R}, ps, ns, tot, 0.5::DOUBLE AS pi, {QBAR.format(pi="0.5::DOUBLE")} AS q, 0 AS step FROM hist
 UNION ALL SELECT {R}, ps, ns, tot, q AS pi, {QBAR.format(pi="q")} AS q, step + 1 FROM em
 WHERE abs(q - pi) >= 1e-6::DOUBLE AND step < 1000"""
SHIFT = f"""SELECT {R}, arg_max(pi, step) AS prior, 1 - arg_max(pi, step) AS threshold FROM em GROUP BY ALL"""
TH = f"""SELECT {R}, '0.5' AS rule, 0.5::DOUBLE AS threshold FROM (SELECT DISTINCT {R} FROM prediction)
 UNION ALL SELECT r.cohort, arm, seed, 'val_youden', y.threshold FROM (SELECT DISTINCT {R} FROM prediction) r
  JOIN youden y USING (arm, seed) WHERE y.cohort = 'val'
 UNION ALL SELECT {R}, 'prior_shift', threshold FROM shift"""
ATRULES = f"""SELECT {R}, rule, threshold, (sensitivity + specificity)/2 AS balanced_accuracy, sensitivity, specificity,
 coalesce((n_1_1*n_0_0 - n_0_1*n_1_0)::DOUBLE / nullif(sqrt(n_1_1+n_0_1)*sqrt(n_1_1+n_1_0)*sqrt(n_0_0+n_0_1)*sqrt(n_0_0+n_1_0), 0), 0.0)
 AS mcc, positive_rate, positive_rate >= 0.95::DOUBLE OR positive_rate <= 1 - 0.95::DOUBLE AS degenerate, {F1} AS macro_f1
 FROM (SELECT *, n_1_1/(n_1_1+n_1_0) AS sensitivity, n_0_0/(n_0_0+n_0_1) AS specificity,
 (n_1_1+n_0_1)/(n_1_1+n_0_1+n_0_0+n_1_0) AS positive_rate FROM (
  SELECT {R}, rule, threshold, count(*) FILTER (y=0 AND p < threshold) AS n_0_0, count(*) FILTER (y=0 AND p >= threshold) AS n_0_1,
  count(*) FILTER (y=1 AND p < threshold) AS n_1_0, count(*) FILTER (y=1 AND p >= threshold) AS n_1_1
  FROM prediction JOIN th USING ({R}) GROUP BY ALL))"""
TC = dict(CTE, youden=YOUDEN, hist=HIST, em=EM, shift=SHIFT, th=TH, atrules=ATRULES)


def tsql(body):
    return sql(body, recursive=True, **TC)


Q["t01_youden"] = (lambda s, d: T.youden(P(s, d), RUN), tsql(f"SELECT {R}, threshold FROM youden"))
Q["t02_prior_shift"] = (lambda s, d: rounded(T.prior_shift(P(s, d), RUN)),
                        tsql(f"SELECT {R}, round(prior, 6) AS prior, round(threshold, 6) AS threshold, TRUE AS converged FROM shift"))
Q["t03_resolve_threshold"] = (
    lambda s, d: T.resolve_threshold(P(s, d), "val_youden").select(*RUN, "threshold"),
    tsql(f"SELECT {R}, threshold FROM th WHERE rule = 'val_youden'"))
MET = "balanced_accuracy, sensitivity, specificity, mcc, positive_rate, macro_f1, threshold".split(", ")
Q["t04_metrics_at_rules"] = (
    lambda s, d: rounded(T.metrics_at_rules(P(s, d))),
    tsql(f"SELECT {R}, rule, degenerate, {', '.join(f'round({m}, 6) AS {m}' for m in MET)} FROM atrules"))
NAMES = [m for m in MET if m != "macro_f1"]
Q["t05_rule_report"] = (
    lambda s, d: rounded(T.rule_report(P(s, d))),
    tsql(f"""SELECT cohort, arm, rule, count(*) AS seeds, {', '.join(f'round(avg({m}), 6) AS {m}, round(stddev_samp({m}), 6) AS {m}_sd'
 for m in NAMES)}, count(*) FILTER (degenerate) || '/' || count(*) AS degenerate_runs FROM atrules GROUP BY ALL"""))
Q["t06_logit"] = (
    lambda s, d: rounded(P(s, d).groupBy(*RUN).agg(F.avg(logit("p")).alias("mean_logit"),
                                                   F.max(logit("p")).alias("max_logit"))),
    sql(f"""SELECT {R}, round(avg(z), 6) AS mean_logit, round(max(z), 6) AS max_logit FROM (SELECT {R}, ln(q/(1-q)) AS z FROM
 (SELECT {R}, least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS q FROM prediction)) GROUP BY ALL"""))
LOGIT = "ln(greatest(least(p, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) / (1 - greatest(least(p, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE)))"
SOFT = "greatest(x, 0) + ln(1 + exp(-abs(x)))"
# nine passes shrink the bracket of log T, ten wide, below 1e-7, each to two of sixteen gaps
TEMP = dict(
    zh=f"SELECT {R}, {LOGIT} AS z, sum(y) AS pos, sum(1 - y) AS neg FROM prediction GROUP BY ALL",
    tst=f"""SELECT DISTINCT {R}, 0 AS i, -5.0::DOUBLE AS lo, 5.0::DOUBLE AS hi FROM prediction UNION ALL
 SELECT {R}, i + 1, lo + (hi - lo) * greatest(arg_min(j, loss) - 1, 0) / 16, lo + (hi - lo) * least(arg_min(j, loss) + 1, 16) / 16 FROM (
 SELECT {R}, i, lo, hi, j, sum(pos * ({SOFT} - x) + neg * ({SOFT})) AS loss FROM (SELECT s.*, j, pos, neg, z / exp(lo + (hi - lo) * j / 16) AS x
 FROM tst s JOIN zh USING ({R}), range(17) g(j) WHERE i < 9) GROUP BY ALL) GROUP BY {R}, i, lo, hi""",
    tmp=f"SELECT {R}, exp((lo + hi) / 2) AS temperature, (lo + hi) / 2 > 5 - 1e-3::DOUBLE AS at_bound FROM tst WHERE i = 9",
    tboth=f"""SELECT q.cohort, q.arm, q.seed, y, stage, CASE stage WHEN 'before' THEN p ELSE 1 / (1 + exp(-{LOGIT} / temperature)) END AS p
 FROM prediction q JOIN (SELECT * FROM tmp WHERE cohort = 'val') t USING (arm, seed), (VALUES ('before'), ('after')) v(stage)""",
    tbin=f"SELECT {R}, stage, abs(sum(y) - sum(p)) AS gap, count(*) AS n FROM tboth GROUP BY {R}, stage, {bin_sql('p')}",
    tece=f"SELECT {R}, stage, sum(gap) / sum(n) AS ece FROM tbin GROUP BY ALL",
    tbri=f"SELECT {R}, stage, avg((p - y) * (p - y)) AS brier, 1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y))) AS brier_skill FROM tboth GROUP BY ALL",
    tall=f"SELECT * FROM tbri JOIN tece USING ({R}, stage) JOIN (SELECT arm, seed, temperature, at_bound FROM tmp WHERE cohort = 'val') USING (arm, seed)")
Q["t07_fit_temperature"] = (
    lambda s, d: T.fit_temperature(P(s, d), RUN).withColumn("temperature", F.round("temperature", 4)),
    sql(f"SELECT {R}, round(temperature, 4) AS temperature, at_bound FROM tmp", recursive=True, **TEMP))
HEAT = ("temperature", "temperature_min", "temperature_max")
Q["t08_temperature_report"] = (
    lambda s, d: rounded(T.temperature_report(P(s, d)).withColumns({c: F.round(c, 4) for c in HEAT})),
    sql("""SELECT cohort, arm, count(DISTINCT seed) AS seeds, round(avg(temperature), 4) AS temperature, round(min(temperature), 4) AS temperature_min,
 round(max(temperature), 4) AS temperature_max, count(*) FILTER (at_bound AND stage = 'after') AS at_bound, """ + ", ".join(
        f"round(avg({c}) FILTER (stage = '{s}'), 6) AS {c}_{s}" for s in ("before", "after") for c in ("brier", "brier_skill", "ece"))
        + " FROM tall GROUP BY ALL", recursive=True, **TEMP))

Q["f01_ensemble"] = (
    lambda s, d: M.roc_auc(U_.ensemble(P(s, d)).withColumn("p", F.round("p", 9)), ["cohort", "arm", "runs"])
    .withColumn("roc_auc", F.round("roc_auc", 6)),
    sql("SELECT cohort, arm, runs, round(roc_auc, 6) AS roc_auc FROM ea",
        ens="SELECT cohort, arm, item_id, max(y) AS y, round(avg(p), 9) AS p, count(*) AS runs FROM prediction GROUP BY ALL",
        ea=auc_sql("cohort, arm, runs", "ens")))
HOLES = "SELECT * FROM prediction WHERE NOT (seed = 1 AND p < 0.1::DOUBLE)"
Q["f02_ensemble_common_items"] = (
    lambda s, d: rounded(U_.ensemble(P(s, d).filter("NOT (seed = 1 AND p < 0.1)"), strict=False)),
    sql("""SELECT cohort, arm, item_id, max(y) AS y, round(avg(p), 6) AS p, 3::BIGINT AS runs FROM holes GROUP BY ALL
 HAVING count(*) = 3""", holes=HOLES))
BY = ["arm", "seed", "item_id"]
B = "arm, seed, item_id"
BYS = ["arm", "seed", "scale", "item_id"]
BS = "arm, seed, scale, item_id"
WHOLE = "SELECT arm, seed, scale, item_id, y, p FROM prediction, (VALUES (0), (1)) t(scale) WHERE arm IN ('full', 'plain')"


def scaled(s, d):
    """The whole-item scores of the two arms that have instances, beside either scale."""
    return V.bag_prediction(s, d).filter("arm IN ('full', 'plain')").withColumn("scale", F.explode(F.array(F.lit(0), F.lit(1))))


def bag(how, fallback=False):
    def run(s, d):
        fb = scaled(s, d).select(*BYS, "p") if fallback else None
        return rounded(U_.bag_scores(I(s, d), BYS, how, 3, 0.5, fb))
    return run


AGGS = {"mean": "avg(p)", "max": "max(p)", "frac": "avg((p >= 0.5::DOUBLE)::INT)",
        "topk": "avg(p) FILTER (rn <= 3)"}
BAG = f"SELECT {BS}, {{a}} AS p FROM (SELECT *, row_number() OVER (PARTITION BY {BS} ORDER BY p DESC) AS rn FROM instance_runs) GROUP BY ALL"
for how in U_.HOW:
    Q[f"f03_bag_{how}"] = (bag(how), sql(f"SELECT {BS}, round(p, 6) AS p FROM bagged", bagged=BAG.format(a=AGGS[how])))
Q["f04_bag_fallback"] = (bag("mean", True), sql(
    f"SELECT {BS}, round(coalesce(b.p, w.p), 6) AS p, b.p IS NULL AS scored_whole FROM whole w LEFT JOIN bagged b USING ({BS})",
    whole=WHOLE, bagged=BAG.format(a="avg(p)")))
Q["f05_multi_scale"] = (
    lambda s, d: rounded(U_.bag_scores(U_.multi_scale(I(s, d), BY), BY, "max")),
    sql(f"SELECT {B}, round(max(p), 6) AS p FROM (SELECT {B}, inst_id, avg(p) AS p FROM instance_runs GROUP BY ALL) GROUP BY ALL"))
Q["f06_view_mean"] = (
    lambda s, d: rounded(U_.view_mean(P(s, d), ["cohort", "arm", "item_id"], 2, "seed")),
    sql("""SELECT cohort, arm, item_id, round(ln(greatest(avg(p), 1e-12::DOUBLE)), 6) AS log_p FROM prediction WHERE seed < 2
 GROUP BY ALL"""))
LONG = f"""SELECT arm, seed, scale, y, unnest(['whole','mean','topk','max']) AS scoring, unnest([w.p, coalesce(b.me, w.p), coalesce(b.tk, w.p),
 coalesce(b.mx, w.p)]) AS p FROM whole w LEFT JOIN b USING ({BS})"""
Q["f07_compare_scorings"] = (
    lambda s, d: rounded(U_.compare_scorings(I(s, d), scaled(s, d), by=("arm", "scale"))),
    sql("""SELECT arm, scale, scoring, count(*) AS seeds, round(avg(roc_auc), 6) AS auc_mean, round(stddev_samp(roc_auc), 6) AS auc_sd
 FROM la GROUP BY ALL""", b=BAG.format(a="round(avg(p), 12) AS me, max(p) AS mx, round(avg(p) FILTER (rn <= 3), 12) AS tk, 0"),
        whole=WHOLE, lng=LONG, la=auc_sql("arm, seed, scale, scoring", "lng")))
Q["f08_score_drift"] = (
    lambda s, d: rounded(U_.score_drift(P(s, d).filter("seed = 0"), P(s, d).filter("seed = 1"),
                                        ["cohort", "arm", "item_id"], ["cohort", "arm"])),
    sql("""SELECT cohort, arm, round(max(abs(a.p - b.p)), 6) AS max_abs, round(avg(abs(a.p - b.p)), 6) AS mean_abs, count(*) AS items
 FROM (SELECT * FROM prediction WHERE seed = 0) a JOIN (SELECT * FROM prediction WHERE seed = 1) b USING (cohort, arm, item_id)
 GROUP BY ALL"""))
Q["f09_alignment"] = (
    lambda s, d: U_.alignment_report(P(s, d).filter("NOT (seed = 1 AND p < 0.1)")),
    sql("""SELECT cohort, 12::BIGINT AS runs, count(*) AS items, count(*) FILTER (n <> 12) AS incomplete_items,
 count(*) FILTER (a <> b) AS label_conflicts FROM (SELECT cohort, item_id, count(*) AS n, min(y) AS a, max(y) AS b FROM holes
 GROUP BY ALL) GROUP BY ALL""", holes=HOLES))
Q["f10_exemplar"] = (
    lambda s, d: rounded(U_.exemplar(I(s, d), 4, ("arm", "seed", "scale"))),
    sql("""SELECT item_id, round(low, 6) AS lowest FROM (SELECT item_id, min(p) AS low, count(*) AS n FROM (SELECT item_id, inst_id,
 avg(p) AS p FROM instance_runs GROUP BY ALL) GROUP BY ALL) WHERE n = 4
 ORDER BY low DESC, item_id LIMIT 1"""))
Q["f11_confident_examples"] = (
    lambda s, d: rounded(U_.confident_examples(P(s, d), 5)),
    sql("""SELECT y, unit, item_id, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY confidence
 DESC, item_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY y, unit ORDER BY confidence DESC, item_id) AS rn FROM (
 SELECT y, unit, item_id, round(min(c), 9) AS confidence FROM (SELECT y, unit, item_id, arm, avg(CASE WHEN y = 1 THEN p ELSE 1 - p END)
 AS c FROM prediction GROUP BY ALL) GROUP BY ALL)) WHERE rn = 1) WHERE k <= 5"""))
