"""Resampling inference and tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from evalspark.operators import dedup as D
from evalspark.operators import infer as B
from evalspark.operators import metrics as M
from evalspark.queries.metrics_queries import BUNDLE, CTE, RUN, R, rounded
from evalspark.queries.oracle import U, WELCH, sql, welch
from evalspark.sources import views as V

P = V.prediction
NB = 200
COMP = ["blend", "jitter", "plain"]
Q = {}


def unit_sql(strata: str, unit: str = "unit", src: str = "prediction") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY {unit}) - 1 AS idx, count(*) OVER (PARTITION BY {strata}) AS n
 FROM (SELECT {strata}, {unit}, count(*) AS rows FROM {src} GROUP BY ALL)"""


def draw_sql(strata: str, unit: str = "unit", units: str = "uni") -> str:
    return f"""SELECT {strata}, u.{unit}, draw, weight FROM (SELECT {strata}, draw, idx, count(*) AS weight FROM (SELECT {strata}, draw,
 least(floor({U(*strata.split(", "), "draw", "idx", "0")} * n)::BIGINT, n - 1) AS idx FROM {units}, (SELECT unnest(range({NB}))::INT AS draw))
 GROUP BY ALL) d JOIN {units} u USING ({strata}, idx)"""


def wm_sql(draws: str = "drw", strata: str = "cohort, y", unit: str = "unit", src: str = "prediction") -> str:
    """Long weighted metrics per run and draw; draw -1 is the observed value."""
    return f"""SELECT {R}, draw, unnest(['roc_auc', 'average_precision', 'macro_f1']) AS metric, unnest([auc, ap, f1]) AS value FROM (
 SELECT {R}, draw, sum(pos * (2 * (nn - fp) + neg)) / (2.0 * max(np) * max(nn)) AS auc, sum(pos * tp / (tp + fp)::DOUBLE) / max(np) AS ap,
 (2 * sum(hp) / (max(np) + sum(hp) + sum(hn)) + 2 * (max(nn) - sum(hn)) / (2 * max(nn) + max(np) - sum(hp) - sum(hn))) / 2 AS f1
 FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {R}, draw) AS np, sum(neg) OVER (PARTITION BY
 {R}, draw) AS nn FROM (SELECT {R}, draw, p, sum(y * weight)::BIGINT AS pos, sum((1 - y) * weight)::BIGINT AS neg,
 sum(CASE WHEN p >= 0.5::DOUBLE THEN y * weight ELSE 0 END)::BIGINT AS hp, sum(CASE WHEN p >= 0.5::DOUBLE THEN (1 - y) * weight ELSE 0 END)::BIGINT AS hn
 FROM {src} JOIN (SELECT * FROM {draws} UNION ALL SELECT {strata}, {unit}, -1, 1 FROM (SELECT DISTINCT {strata}, {unit} FROM {src}))
 USING ({strata}, {unit}) GROUP BY ALL) WINDOW w AS (PARTITION BY {R}, draw ORDER BY p DESC)) GROUP BY ALL)"""


BASE = dict(CTE, uni=unit_sql("cohort, y"), drw=draw_sql("cohort, y"), wmet=wm_sql())


def delta_sql(src: str, keys: str, floor: str, observed: Sequence[str] = ()) -> str:
    more = "".join(f"max({c}) FILTER (draw = -1) AS {c}, " for c in observed)
    return f"""SELECT {keys}, {more}max(d) FILTER (draw = -1) AS delta, quantile_cont(d, 0.025) FILTER (draw >= 0) AS ci_low,
 quantile_cont(d, 0.975) FILTER (draw >= 0) AS ci_high, least(1.0, greatest({floor}, 2 * least(avg((d <= 0)::INT) FILTER (draw >= 0),
 avg((d >= 0)::INT) FILTER (draw >= 0)))) AS p FROM {src} GROUP BY ALL"""


def holm_sql(src: str, family: str, order: str) -> str:
    return f"""SELECT *, max(st) OVER (PARTITION BY {family} ORDER BY p, {order} ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *,
 least(1.0, (count(*) OVER (PARTITION BY {family}) - row_number() OVER (PARTITION BY {family} ORDER BY p, {order}) + 1) * p) AS st FROM {src})"""


PAIRED = f"""SELECT b.cohort, b.seed, b.arm AS baseline, metric, draw, r.value - b.value AS d FROM (SELECT * FROM wmet WHERE arm <> 'full') b
 JOIN (SELECT * FROM wmet WHERE arm = 'full') r USING (cohort, seed, draw, metric)"""
BASE.update(pairsd=PAIRED, pairb=delta_sql("pairsd", "cohort, seed, baseline, metric", f"1.0 / ({NB} + 1)"),
            pairh=holm_sql("pairb", "cohort, seed", "baseline, metric"))
R8 = """round(reference_value, 6) AS reference_value, round(comparator_value, 6) AS comparator_value, round(p_holm, 6) AS p_holm,
 CASE WHEN p_holm < 0.05 THEN 'yes' ELSE 'no' END AS significant"""
R5 = "round(delta, 6) AS delta, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p, 6) AS p"


def bsql(body, **kw):
    return sql(body, **{**BASE, **kw})


Q["b01_units"] = (lambda s, d: B.units(P(s, d)),
                  bsql("SELECT cohort, y, unit, rows, idx, n FROM uni"))
Q["b02_draw_units"] = (
    lambda s, d: B.draw_unit_totals(B.units(P(s, d)), NB),
    bsql("""SELECT cohort, y, draw, count(*) AS drawn, sum(weight)::BIGINT AS total, max(weight) AS most FROM drw GROUP BY ALL"""))
Q["b03_draw_items"] = (
    lambda s, d: B.draw_items(V.items(s, d), NB).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("draws"), F.sum("weight").alias("total")),
    sql("SELECT item_id, count(*) AS draws, sum(weight)::BIGINT AS total FROM drwi GROUP BY ALL",
        unii=unit_sql("cohort", "item_id", "items"), drwi=draw_sql("cohort", "item_id", "unii")))
Q["b04_weighted_metrics"] = (
    lambda s, d: rounded(B.weighted_metrics(P(s, d), B.make_weights(P(s, d), NB), RUN)),
    bsql(f"SELECT {R}, draw, metric, round(value, 6) AS value FROM wmet"))
Q["b05_paired_bootstrap"] = (
    lambda s, d: rounded(B.paired_bootstrap(P(s, d), "full", COMP, NB)),
    bsql(f"SELECT cohort, seed, baseline, metric, {R5} FROM pairb"))
Q["b06_compare_all"] = (
    lambda s, d: rounded(B.compare_all(P(s, d), "full", COMP, NB)),
    bsql(f"""SELECT cohort, seed, baseline, metric, {R5}, round(p_holm, 6) AS p_holm, n_units, CASE WHEN p_holm < 0.05 THEN 'yes' ELSE 'no' END
 AS significant FROM pairh JOIN (SELECT cohort, count(*) AS n_units FROM uni GROUP BY ALL) USING (cohort)"""))
Q["b06_absent_baselines"] = (
    lambda s, d: B.absent_baselines(P(s, d).filter("NOT (arm = 'plain' AND seed = 2)"), "full", [*COMP, "extra"]),
    sql("""SELECT DISTINCT cohort, seed, baseline FROM prediction, (VALUES ('blend'), ('jitter'), ('plain'), ('extra')) t(baseline)
 WHERE arm = 'full' AND (baseline = 'extra' OR (baseline = 'plain' AND seed = 2))"""))
Q["b07_holm"] = (
    lambda s, d: rounded(B.holm(M.brier(P(s, d), RUN).select(*RUN, (F.col("brier") / 20).alias("p")),
                                ["cohort"], "p", ["arm", "seed"])),
    sql(f"SELECT {R}, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM hh",
        br=f"SELECT {R}, avg((p-y)*(p-y)) / 20 AS p FROM prediction GROUP BY ALL", hh=holm_sql("br", "cohort", "arm, seed")))
Q["b08_seed_summary"] = (
    lambda s, d: rounded(M.seed_summary(M.roc_auc(P(s, d), RUN), ["cohort", "arm"], ["roc_auc"])),
    sql("""SELECT cohort, arm, count(*) AS seeds, round(avg(roc_auc), 6) AS roc_auc_mean, round(stddev_samp(roc_auc), 6) AS roc_auc_sd,
 bool_and(roc_auc > 0) AS roc_auc_positive FROM auc GROUP BY ALL""", **CTE))
Q["b09_auc_ci"] = (
    lambda s, d: rounded(B.auc_ci(P(s, d), NB)),
    bsql(f"""SELECT {R}, round(max(value) FILTER (draw = -1), 6) AS roc_auc, round(quantile_cont(value, 0.025) FILTER (draw >= 0), 6) AS ci_low,
 round(quantile_cont(value, 0.975) FILTER (draw >= 0), 6) AS ci_high FROM wmet WHERE metric = 'roc_auc' GROUP BY ALL"""))
CI = f"""SELECT {R}, round(quantile_cont(value, 0.025) FILTER (draw >= 0), 6) AS auc_ci_low, round(quantile_cont(value, 0.975) FILTER (draw >= 0), 6)
 AS auc_ci_high FROM wmet WHERE metric = 'roc_auc' GROUP BY ALL"""
RUNS = f"SELECT *, 0.5::DOUBLE AS threshold FROM ({BUNDLE}) JOIN ({CI}) USING ({R})"
Q["k21_run_bundle"] = (lambda s, d: rounded(B.run_bundle(P(s, d), NB)), bsql(RUNS))


def arms_sql(src: str = "wmet") -> str:
    pick = f"least(floor({U('cohort', 'arm', 'metric', 'draw', 'j', '0')} * k)::BIGINT, k - 1)"
    return f"""SELECT cohort, arm, metric, draw, avg(value) AS value, max(k)::INT AS seeds FROM (
 SELECT cohort, arm, metric, draw, k, CASE WHEN draw = -1 THEN v[j + 1] ELSE v[{pick} + 1] END AS value FROM (
 SELECT *, unnest(range(k)) AS j FROM (SELECT cohort, arm, metric, draw, list(value ORDER BY seed) AS v, count(*) AS k FROM {src} GROUP BY ALL)))
 GROUP BY ALL"""


def method_sql(arms: str, pairs: str) -> str:
    return f"""SELECT cohort, metric, draw, family, reference, comparator, r.seeds AS reference_seeds, c.seeds AS comparator_seeds,
 r.value AS reference_value, c.value AS comparator_value, r.value - c.value AS d FROM {pairs} JOIN {arms} r ON r.arm = reference JOIN {arms} c ON c.arm = comparator AND c.cohort = r.cohort
 AND c.metric = r.metric AND c.draw = r.draw"""


def methods(prefix: str, wm: str, pairs: str) -> dict[str, str]:
    md = method_sql(f"{prefix}arms", f"{prefix}pairs").replace("SELECT cohort, metric, draw", "SELECT r.cohort, r.metric, r.draw")
    return {f"{prefix}arms": arms_sql(wm), f"{prefix}pairs": pairs, f"{prefix}d": md,
            f"{prefix}b": delta_sql(f"{prefix}d", "cohort, metric, family, reference, comparator, reference_seeds, comparator_seeds",
                                    f"1.0 / ({NB} + 1)", ("reference_value", "comparator_value")),
            f"{prefix}h": holm_sql(f"{prefix}b", "cohort, metric, family", "reference, comparator")}


MPAIRS = "SELECT 'methods' AS family, 'full' AS reference, unnest(['blend', 'jitter', 'plain']) AS comparator"
MKEYS = "cohort, metric, reference, comparator, reference_seeds, comparator_seeds"
MT = methods("mt_", "wmet", MPAIRS)
Q["b10_method_tests"] = (
    lambda s, d: rounded(B.method_tests(P(s, d), "full", COMP, NB)),
    bsql(f"SELECT {MKEYS}, {R5}, {R8} FROM mt_h WHERE metric <> 'macro_f1'", **MT))
RPAIRS = "SELECT 'methods' AS family, 'full' AS reference, unnest(['blend', 'plain']) AS comparator"
REPLICATE = f"SELECT {MKEYS}, {R5}, {R8} FROM rp_h WHERE metric <> 'macro_f1' AND cohort = 'testb'"
RP = {**BASE, **methods("rp_", "wmet", RPAIRS)}
FAM = {"components": [("full", "plain"), ("full", "jitter")], "pairs": [("blend", "plain")]}
FPAIRS = "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{a}', '{b}')" for f, v in FAM.items() for a, b in v) + \
    ") t(family, reference, comparator)"
FSRC = "SELECT * FROM prediction WHERE seed IN (0, 1)"
FT = dict(fsrc=FSRC, funi=unit_sql("cohort, y", "unit", "fsrc"), fdrw=draw_sql("cohort, y", "unit", "funi"),
          fwm=wm_sql("fdrw", src="fsrc"), **methods("ft_", "fwm", FPAIRS))
Q["b11_family_tests"] = (
    lambda s, d: rounded(B.family_tests(P(s, d), FAM, NB, seeds=[0, 1])),
    bsql(f"SELECT {MKEYS}, family, {R5}, {R8} FROM ft_h WHERE metric = 'roc_auc'", **FT))
SUBW = f"""SELECT {R}, draw, subtype, p, sum(weight)::BIGINT AS k FROM prediction JOIN (SELECT * FROM sdrw UNION ALL SELECT cohort, subtype, unit,
 -1, 1 FROM suni) USING (cohort, subtype, unit) GROUP BY ALL"""
SUBA = f"""SELECT {R}, draw, subtype, sum(k * (2 * below + coalesce(neg, 0))) / (2.0 * sum(k) * max(nn)) AS auc FROM (
 SELECT s.*, neg, below, nn FROM (SELECT * FROM subw WHERE subtype <> 'base') s JOIN (SELECT {R}, draw, p, neg, sum(neg) OVER (PARTITION BY {R}, draw
 ORDER BY p) - neg AS below, sum(neg) OVER (PARTITION BY {R}, draw) AS nn FROM (SELECT {R}, draw, p, sum(CASE WHEN subtype = 'base' THEN k ELSE 0 END)
 AS neg FROM subw GROUP BY ALL)) USING ({R}, draw, p)) GROUP BY ALL"""
Q["b12_subtype_ci"] = (
    lambda s, d: rounded(B.subtype_ci(P(s, d), NB)),
    sql("""SELECT cohort, arm, subtype, round(max(d) FILTER (draw = -1), 6) AS roc_auc, round(quantile_cont(d, 0.025) FILTER (draw >= 0), 6) AS ci_low,
 round(quantile_cont(d, 0.975) FILTER (draw >= 0), 6) AS ci_high FROM (SELECT cohort, arm, subtype, draw, avg(auc) AS d FROM suba GROUP BY ALL)
 GROUP BY ALL""", suni="SELECT cohort, subtype, unit, idx, n FROM (" + unit_sql("cohort, subtype") + ")",
        sdrw=draw_sql("cohort, subtype", "unit", "suni"), subw=SUBW, suba=SUBA))


def sensitivity(s, d):
    blocks = D.contiguous_blocks(V.items(s, d), ["subtype"], ["item_id"], 89).select(
        "item_id", F.concat_ws("_", "subtype", "block").alias("block"))
    return rounded(B.unit_sensitivity(P(s, d), blocks, "full", COMP, NB))


SENS = dict(blk="""SELECT item_id, subtype || '_' || (ntile(89) OVER (PARTITION BY subtype ORDER BY item_id) - 1) AS block FROM items""",
            psrc="SELECT p.*, block FROM prediction p JOIN blk USING (item_id)",
            puni=unit_sql("cohort, subtype", "block", "psrc"), pdrw=draw_sql("cohort, subtype", "block", "puni"),
            pwm=wm_sql("pdrw", "cohort, subtype", "block", "psrc"), **methods("st_", "pwm", MPAIRS), **MT)
Q["b13_unit_sensitivity"] = (
    sensitivity,
    bsql("""SELECT cohort, metric, reference, comparator, round(a.delta, 6) AS delta, round(a.ci_low, 6) AS ci_low, round(a.ci_high, 6)
 AS ci_high, round(a.p, 6) AS p, round(a.p_holm, 6) AS p_holm, round(b.ci_low, 6) AS primary_ci_low, round(b.ci_high, 6) AS primary_ci_high,
 round(b.p_holm, 6) AS primary_p_holm FROM st_h a JOIN mt_h b USING (cohort, metric, reference, comparator) WHERE metric <> 'macro_f1'""", **SENS))


def welch_rows(s, d):
    m = M.brier(P(s, d), RUN).select(*RUN, F.col("brier").alias("value"))
    return B.t_test(m.filter("arm IN ('full', 'plain')"), ["cohort"], "arm", "value", "full", "plain")


Q["b14_t_test"] = (
    lambda s, d: rounded(welch_rows(s, d).drop("ci_low", "ci_high", "p")),
    sql("""SELECT cohort, 'Welch t' AS test, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(ma - mb, 6) AS delta,
 round((va+vb)*(va+vb)/(va*va/(na-1) + vb*vb/(nb-1)), 6) AS df, round((ma - mb)/sqrt(va+vb), 6) AS t FROM (SELECT cohort,
 avg(b) FILTER (arm = 'full') AS ma, avg(b) FILTER (arm = 'plain') AS mb, count(*) FILTER (arm = 'full') AS na, count(*) FILTER (arm = 'plain') AS nb,
 var_samp(b) FILTER (arm = 'full') / count(*) FILTER (arm = 'full') AS va, var_samp(b) FILTER (arm = 'plain') / count(*) FILTER (arm = 'plain') AS vb
 FROM (SELECT cohort, arm, seed, avg((p-y)*(p-y)) AS b FROM prediction GROUP BY ALL) GROUP BY ALL)"""))
# three seeds leave two degrees of freedom, whose quantile has a closed form
T2 = "0.95::DOUBLE / sqrt(2 * 0.975::DOUBLE * 0.025::DOUBLE) * stddev_samp(VALUE) / sqrt(count(*))"
Q["b14_t_test_p"] = (
    lambda s, d: rounded(welch_rows(s, d)),
    sql(f"SELECT cohort, test, {WELCH} FROM wp", **welch("brs", "cohort"), brs="""SELECT cohort, CASE arm WHEN 'full' THEN 'a' ELSE 'b' END AS side, avg((p-y)*(p-y)) AS value
 FROM prediction WHERE arm IN ('full', 'plain') GROUP BY cohort, arm, seed"""))
Q["b15_t_interval"] = (
    lambda s, d: rounded(B.t_interval(M.brier(P(s, d), RUN), ["cohort", "arm"], "brier")),
    sql(f"""SELECT cohort, arm, count(*) AS n, round(avg(b), 6) AS mean, round(avg(b) - {T2}, 6) AS ci_low, round(avg(b) + {T2}, 6) AS ci_high
 FROM (SELECT cohort, arm, seed, avg((p-y)*(p-y)) AS b FROM prediction GROUP BY ALL) GROUP BY ALL""".replace("VALUE", "b")))
Q["b16_seed_tests"] = (
    lambda s, d: rounded(B.seed_tests(P(s, d), "full", COMP, B.method_tests(P(s, d), "full", COMP, NB))),
    bsql(f"""SELECT cohort, metric, comparator, test, {WELCH}, round(w.p_holm, 6) AS p_holm, round(b.p_holm, 6) AS bootstrap_p_holm FROM wh w
 JOIN (SELECT cohort, metric, comparator, p_holm FROM mt_h) b USING (cohort, metric, comparator)""", **MT, **welch("seedv", "cohort, metric, comparator"),
         wh=holm_sql("wp", "cohort, metric", "comparator"),
         seedv="""SELECT cohort, metric, comparator, CASE arm WHEN 'full' THEN 'a' ELSE 'b' END AS side, value FROM wmet, (VALUES ('blend'), ('jitter'), ('plain')) c(comparator)
 WHERE draw = -1 AND metric IN ('roc_auc', 'average_precision') AND arm IN ('full', comparator)"""))
PAIRS = [("val", "testa"), ("val", "testb"), ("testa", "testb")]
Q["b17_rank_agreement"] = (
    lambda s, d: rounded(B.rank_agreement(
        M.brier(P(s, d), ["cohort", "arm", "seed"]).select("cohort", F.concat_ws("_", "arm", "seed").alias("arm"),
                                                           F.round("brier", 9).alias("value")), PAIRS)),
    sql("""SELECT a.cohort AS cohort_a, b.cohort AS cohort_b, count(*) AS configurations, round(corr(a.r, b.r), 6) AS spearman_rho FROM rk a JOIN rk b
 USING (arm, seed) WHERE (a.cohort, b.cohort) IN (('val', 'testa'), ('val', 'testb'), ('testa', 'testb')) GROUP BY ALL""",
        rk="""SELECT *, rank() OVER (PARTITION BY cohort ORDER BY v) + (count(*) OVER (PARTITION BY cohort, v) - 1) / 2.0::DOUBLE AS r FROM
 (SELECT cohort, arm, seed, round(avg((p-y)*(p-y)), 9) AS v FROM prediction GROUP BY ALL)"""))
Q["b18_cohort_table"] = (
    lambda s, d: rounded(B.cohort_table(P(s, d))),
    sql("""SELECT cohort, count(*) AS items, sum(y)::BIGINT AS positives, round(avg(y), 6) AS prevalence, 12::BIGINT AS runs, 4::BIGINT AS arms
 FROM items GROUP BY ALL"""))
