"""Shortcut and confounding audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.columns import uniform
from evalspark.operators import confound as X
from evalspark.queries.curate_queries import CHAIN, MANIFEST, MAP, OPP, ROWS, denied, same_entity
from evalspark.queries.infer_queries import BASE, NB, REPLICATE, RP, RUNS, T2
from evalspark.queries.metrics_queries import R, auc_sql, rounded
from evalspark.queries.oracle import U, grain, sql
from evalspark.sources import views as V
from evalspark.sources.views import grain as vgrain

Q = {}
COLS = ["f1", "f2", "f3"]
NPERM = 100


def doc_prediction(s, d):
    """Runs over the labelled documents: a score mixed from label, a feature and noise."""
    runs = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(k).alias("seed"), F.lit(w).alias("w"))
                               for a, w in (("full", 0.2), ("plain", 0.1)) for k in (0, 1, 2)]))
    f = V.features(s, d).withColumn("run", runs).select("item_id", "y", "f1", "run.*")
    p = 0.3 + F.col("w") * F.col("y") + F.lit(0.02) * F.col("f1") + 0.3 * uniform("item_id", "arm", "seed")
    return f.withColumn("p", vgrain(p)).select("arm", "seed", "item_id", "y", "p")


DP = f"""SELECT arm, seed, item_id, y, f1, {grain("0.3::DOUBLE + w * y + 0.02::DOUBLE * f1 + 0.3::DOUBLE * " + U("item_id", "arm", "seed"))} AS p
 FROM features, (VALUES ('full', 0.2::DOUBLE), ('plain', 0.1::DOUBLE)) a(arm, w), seed_list"""


def q(name, fn, body=None, **kw):
    Q[name] = (fn, sql(body, **kw) if body else None)


def mask():
    return F.col("value") > 0.03


q("x01_masked_stats", lambda s, d: rounded(X.masked_stats(V.heat_grid(s, d), ["item_id"], mask(), "value", 26)),
  """SELECT item_id, n, round(CASE WHEN n > 26 THEN m ELSE m0 END, 6) AS mean, round(CASE WHEN n > 26 THEN s ELSE s0 END, 6) AS sd FROM (SELECT item_id,
 count(*) FILTER (value > 0.03::DOUBLE) AS n, avg(value) FILTER (value > 0.03::DOUBLE) AS m, stddev_pop(value) FILTER (value > 0.03::DOUBLE) AS s,
 avg(value) AS m0, stddev_pop(value) AS s0 FROM heat_grid GROUP BY ALL)""")
q("x02_in_mask_stats", lambda s, d: rounded(X.masked_stats(V.heat_grid(s, d), ["item_id"], mask(), "value", 24, fallback=False)),
  """SELECT item_id, n, round(CASE WHEN n >= 24 THEN m END, 6) AS mean, round(CASE WHEN n >= 24 THEN s END, 6) AS sd FROM (SELECT item_id,
 count(*) FILTER (value > 0.03::DOUBLE) AS n, avg(value) FILTER (value > 0.03::DOUBLE) AS m, stddev_pop(value) FILTER (value > 0.03::DOUBLE) AS s
 FROM heat_grid GROUP BY ALL)""")
q("x03_standardise", lambda s, d: rounded(X.standardise(V.features(s, d), COLS).select("item_id", *COLS)),
  "SELECT item_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in COLS) + " FROM features")
q("x04_folds_grouped", lambda s, d: X.assign_folds(V.features(s, d), groups="unit").select("item_id", "unit", "fold"),
  """SELECT item_id, unit, fold FROM features JOIN (SELECT unit, (CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END)::INT AS fold FROM (SELECT unit,
 row_number() OVER (ORDER BY count(*) DESC, unit) - 1 AS r FROM features GROUP BY unit)) USING (unit)""")
q("x04_folds_stratified", lambda s, d: X.assign_folds(V.features(s, d)).select("item_id", "y", "fold"),
  f"SELECT item_id, y, ((row_number() OVER (PARTITION BY y ORDER BY {U('item_id', '0')}, item_id) - 1) % 5)::INT AS fold FROM features")
q("x05_cv_auc", lambda s, d: X.cv_auc(V.features(s, d), COLS, "unit").withColumn("cv_auc", F.round("cv_auc", 4)))
RES = "SELECT *, round(s - (regr_intercept(s, f1) OVER r + regr_slope(s, f1) OVER r * f1), 9) AS residual FROM (SELECT *, ln(p / (1 - p)) AS s FROM dp) WINDOW r AS (PARTITION BY arm, seed)"
q("x06_residual_auc", lambda s, d: rounded(X.residual_auc(doc_prediction(s, d), V.features(s, d), ["f1"], ["arm", "seed"])),
  """SELECT arm, seed, round(a.roc_auc, 6) AS auc, round(b.roc_auc, 6) AS auc_residual, round(r2, 6) AS r2 FROM xa a JOIN xb b USING (arm, seed) JOIN
 (SELECT arm, seed, 1 - var_pop(residual) / var_pop(s) AS r2 FROM resid GROUP BY ALL) USING (arm, seed)""",
  dp=DP, resid=RES, xa=auc_sql("arm, seed", "resid", "s"), xb=auc_sql("arm, seed", "resid", "residual"))
q("x06_residual_auc_features", lambda s, d: rounded(X.residual_auc(doc_prediction(s, d), X.standardise(V.features(s, d), COLS), COLS, ["arm", "seed"])))
q("x07_permutations", lambda s, d: X.permutations(V.features(s, d), NPERM),
  f"""SELECT perm, a.item_id, b.item_id AS donor FROM (SELECT item_id, perm, row_number() OVER (PARTITION BY perm ORDER BY {U("item_id", "perm")}, item_id) AS idx
 FROM features, (SELECT unnest(range({NPERM}))::INT AS perm)) a JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) AS idx FROM features) b USING (idx)""")
q("x07_permutation_control", lambda s, d: rounded(X.permutation_control(doc_prediction(s, d), X.standardise(V.features(s, d), COLS), COLS, NPERM)))
q("x08_control_score", lambda s, d: X.control_score(V.features(s, d), COLS, "unit").select(
    "arm", *[F.round(c, 4).alias(c) for c in ("auc", "auc_residual", "r2")]))


def swap_rounded(df):
    """Shifts are means of three-decimal scores; eight places keep them clear of rounding ties."""
    dp = [c for c in df.columns if c.startswith("dp_")]
    return rounded(df.withColumns({c: F.round(c, 8) for c in dp}), keep=dp)


SW = dict(
    sauc=auc_sql(f"{R}, condition", "swap_scores"),
    skind=f"SELECT {R}, regexp_replace(condition, '[0-9]+$', '') AS kind, avg(roc_auc) AS auc FROM sauc GROUP BY ALL",
    sdp=f"""SELECT {R}, regexp_replace(condition, '[0-9]+$', '') AS kind, avg(dp) AS dp FROM (SELECT {R}, s.condition, avg(CASE WHEN s.y = 1 THEN o.p - s.p ELSE s.p - o.p END)
 AS dp FROM swap_scores s JOIN (SELECT {R}, item_id, p FROM swap_scores WHERE condition = 'original') o USING ({R}, item_id) GROUP BY ALL) GROUP BY ALL""",
    swe=f"""SELECT {R}, max(auc) FILTER (kind = 'original') AS auc, max(auc) FILTER (kind = 'none') AS auc_none, max(auc) FILTER (kind = 'other') AS auc_other,
 max(auc) FILTER (kind = 'same') AS auc_same, max(dp) FILTER (kind = 'other') AS dp_towards_other_other, max(dp) FILTER (kind = 'same') AS dp_towards_other_same
 FROM skind LEFT JOIN sdp USING ({R}, kind) GROUP BY ALL""")
q("x09_swap_effects", lambda s, d: swap_rounded(X.swap_effects(V.swap_scores(s, d))),
  f"""SELECT {R}, {", ".join(f"round({c}, {8 if c.startswith('dp') else 6}) AS {c}" for c in ("auc", "auc_none", "auc_other", "auc_same", "dp_towards_other_other", "dp_towards_other_same"))},
 round(auc - auc_other, 6) AS auc_drop_other, round(auc - auc_same, 6) AS auc_drop_same, round(auc_same - auc_other, 6) AS class_specific_effect FROM swe""", **SW)
q("x10_swap_intervals", lambda s, d: rounded(X.swap_summary(X.swap_effects(V.swap_scores(s, d)), [("full", "plain"), ("blend", "jitter")])[0]),
  f"""SELECT cohort, arm, count(*) AS n, round(avg(e), 6) AS mean, round(avg(e) - {T2}, 6) AS ci_low, round(avg(e) + {T2}, 6) AS ci_high
 FROM (SELECT cohort, arm, auc_same - auc_other AS e FROM swe) GROUP BY ALL""".replace("VALUE", "e"), **SW)
q("x10_swap_pairs", lambda s, d: rounded(X.swap_summary(X.swap_effects(V.swap_scores(s, d)), [("full", "plain"), ("blend", "jitter")])[1].drop("ci_low", "ci_high")),
  """SELECT cohort, pair, count(*) AS n, round(avg(dd), 6) AS mean, count(*) FILTER (dd > 0) || '/' || count(*) AS positive FROM (SELECT a.cohort,
 unnest([b.arm || ' - ' || a.arm, 'all pairs']) AS pair, (b.auc_same - b.auc_other) - (a.auc_same - a.auc_other) AS dd FROM swe a JOIN swe b USING (cohort, seed)
 WHERE (a.arm, b.arm) IN (('full', 'plain'), ('blend', 'jitter'))) GROUP BY ALL""", **SW)


def detector(s, d):
    return X.detector_features(V.items(s, d).select("item_id", "y", "subtype"), V.instance(s, d))


DET = """SELECT i.item_id, i.y, i.subtype, count(inst_id) AS n_detected, CASE WHEN count(*) FILTER (keep) > 0 THEN count(*) FILTER (keep) ELSE count(inst_id) END AS n_kept,
 CASE WHEN count(inst_id) > 0 THEN 1 - count(*) FILTER (keep) / count(inst_id) ELSE 0.0 END AS frac_filtered,
 coalesce(CASE WHEN count(*) FILTER (keep) > 0 THEN avg(r) FILTER (keep) ELSE avg(r) END, 0.0) AS mean_radius,
 (count(inst_id) > 0 AND count(*) FILTER (keep) = 0)::INT AS fallback_kept_all, (count(inst_id) = 0)::INT AS scored_whole
 FROM items i LEFT JOIN instance USING (item_id) GROUP BY ALL"""
q("x11_detector_features", lambda s, d: rounded(detector(s, d)),
  "SELECT * REPLACE (round(frac_filtered, 6) AS frac_filtered, round(mean_radius, 6) AS mean_radius) FROM det", det=DET)
q("x12_coverage", lambda s, d: rounded(X.coverage(detector(s, d), [F.concat(F.lit("class "), F.col("y").cast("string")), F.col("subtype")])),
  """SELECT subset, quantile_cont(n_kept, 0.25) AS kept_q1, quantile_cont(n_kept, 0.5) AS kept_median, quantile_cont(n_kept, 0.75) AS kept_q3,
 quantile_cont(n_detected, 0.5) AS detected_median, round(quantile_cont(mean_radius, 0.5) FILTER (n_kept > 0), 6) AS radius_median, count(*) AS items,
 round(avg(frac_filtered), 6) AS frac_filtered, sum(fallback_kept_all)::BIGINT AS fallback_kept_all, sum(scored_whole)::BIGINT AS scored_whole
 FROM (SELECT *, unnest(['class ' || y, subtype]) AS subset FROM det) GROUP BY ALL""", det=DET)
q("x13_transfer_audit", lambda s, d: X.transfer_audit(
    V.features(s, d).withColumn("f3", F.when(F.col("f3") < 0.2, F.col("f3"))), "subtype", "en", COLS).withColumn("roc_auc", F.round("roc_auc", 4)))
q("x14_instance_rule", lambda s, d: rounded(X.instance_rule(V.instance_runs(s, d), V.items(s, d), ["arm", "seed"])),
  "SELECT arm, seed, round(roc_auc, 6) AS roc_auc FROM ira",
  irm="SELECT arm, seed, item_id, y, round(avg(p), 12) AS p FROM instance_runs JOIN items USING (item_id) GROUP BY ALL", ira=auc_sql("arm, seed", "irm"))
q("x15_pair_separability", lambda s, d: X.pair_separability(V.features(s, d), COLS, [("en", "fr"), ("en", "de"), ("fr", "de")])
  .withColumn("cv_auc", F.round("cv_auc", 4)))


def probe(s, d):
    m = V.vector(s, d).groupBy("item_id", "label").pivot("channel", [0, 1, 2, 3]).agg(F.avg("value"))
    m = m.select("item_id", (F.col("label") >= 5).cast("int").alias("y"), *[F.col(str(i)).alias(f"c{i}") for i in range(4)])
    hold = uniform("item_id", F.lit("split")) < 0.3
    return X.linear_probe(m.filter(~hold), m.filter(hold), [f"c{i}" for i in range(4)], [0.01, 0.1, 1.0, 10.0]).withColumn(
        "val_auc", F.round("val_auc", 4))


q("x16_linear_probe", probe)


def replicated(part):
    return lambda s, d: rounded(X.replicate(V.prediction(s, d), "testb", "full", ["blend", "plain"], NB)[part])


def replicate_audit(part):
    """The labelled documents as the replicate: their scores, and their features as the background."""
    return lambda s, d: rounded(X.replicate_audit(doc_prediction(s, d), V.features(s, d), COLS)[part])


q("x17_replicate", replicated("tests"), REPLICATE, **RP)
q("x17_replicate_runs", replicated("runs"), f"SELECT * FROM ({RUNS}) WHERE cohort = 'testb'", **BASE)
MEANS = ("roc_auc", "average_precision", "macro_f1", "positive_rate", "ece")
q("x17_replicate_summary", lambda s, d: X.replicate(V.prediction(s, d), "testb", "full", ["blend", "plain"], NB)["summary"].select(
    "arm", "seeds", *[F.round(c, 4).alias(c) for c in ("roc_auc_sd", *MEANS)]),
  f"""SELECT arm, count(*) AS seeds, round(stddev_samp(roc_auc), 4) AS roc_auc_sd, {", ".join(f"round(avg({c}), 4) AS {c}" for c in MEANS)} FROM ({RUNS}) WHERE cohort = 'testb' GROUP BY ALL""", **BASE)
q("x17_replicate_residual", replicate_audit("residual"))
q("x17_replicate_background", replicate_audit("background"))
q("x17_replicate_cohort", lambda s, d: X.replicate_cohort(V.box(s, d), same_entity(s, d), MAP, OPP, denied=denied(s, d)).groupBy("class_name", "leukemia_type").agg(
    F.count(F.lit(1)).alias("crops"), F.countDistinct("slide").alias("slides"), F.sum("window_h").alias("window_h")),
  f"""SELECT class_name, leukemia_type, count(*) AS crops, count(DISTINCT slide) AS slides, sum(window_h)::BIGINT AS window_h FROM ({MANIFEST}) GROUP BY ALL""",
  recursive=True, **{**ROWS, **CHAIN})
