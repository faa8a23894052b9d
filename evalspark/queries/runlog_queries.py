"""Run logs, resources and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import metrics as M
from evalspark.operators import runlog as L
from evalspark.operators import thresholds as T
from evalspark.queries.fuse_queries import TC
from evalspark.queries.metrics_queries import CTE, RUN, R, rounded
from evalspark.queries.oracle import sql, WELCH, welch
from evalspark.sources import views as V
from evalspark.sources.tables import table

Q = {}
LATEST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, epoch ORDER BY arrival DESC) AS rn FROM train_log) WHERE rn = 1"
SEL = """SELECT run_id, arm, seed, epoch AS selected_epoch, metric, loss FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY metric DESC,
 loss, epoch) AS rn FROM latest) WHERE rn = 1"""
FIRST10 = "SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS i FROM latest"
CURVE = """SELECT run_id, arm, count(*) AS epochs, max(metric) AS selected, avg(metric) AS mean_all, max(metric) FILTER (epoch = 5) AS epoch_5,
 arg_max(metric, epoch) AS last, avg(metric) FILTER (i <= 10) AS mean_first_10 FROM f10 GROUP BY ALL"""
C = dict(latest=LATEST, sel=SEL, f10=FIRST10, crv=CURVE)


def latest(s, d):
    return L.latest_epoch(V.train_log(s, d))


def q(name, fn, body, **kw):
    Q[name] = (fn, sql(body, **{**C, **kw}) if body else None)


q("l01_select_runs", lambda s, d: L.select_runs(V.train_log(s, d), r"^cls_[a-z]+_seed[0-4]$").groupBy("run_id").agg(
    F.count(F.lit(1)).alias("n")),
  "SELECT run_id, count(*) AS n FROM train_log WHERE regexp_matches(run_id, '^cls_[a-z]+_seed[0-4]$') GROUP BY ALL")
q("l02_latest_epoch", lambda s, d: latest(s, d).select("run_id", "epoch", "arrival", "metric", "loss"),
  "SELECT run_id, epoch, arrival, metric, loss FROM latest")
q("l03_selected_epoch", lambda s, d: L.selected_epoch(latest(s, d)).fillna(-1, ["logged_best_epoch"]),
  """SELECT s.run_id, selected_epoch, metric, loss, coalesce(logged_best_epoch, -1) AS logged_best_epoch, selected_epoch IS DISTINCT FROM logged_best_epoch AS differs FROM sel s
 LEFT JOIN (SELECT run_id, max(epoch) AS logged_best_epoch FROM latest WHERE is_best = 1 GROUP BY ALL) USING (run_id)""")
q("l04_running_best", lambda s, d: L.running_best(latest(s, d)).select("run_id", "epoch", "metric", "loss", "best"),
  """SELECT run_id, epoch, metric, loss, (pm IS NULL OR metric > pm OR (metric = pm AND loss < pl))::INT AS best FROM (SELECT *, (pb).m AS pm, -(pb).l AS pl
 FROM (SELECT *, max({'m': metric, 'l': -loss}) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb
 FROM latest))""")
q("l05_curve_summary", lambda s, d: rounded(L.curve_summary(latest(s, d))),
  """SELECT run_id, arm, epochs, selected, round(mean_all, 6) AS mean_all, epoch_5, last, round(mean_first_10, 6) AS mean_first_10 FROM crv""")
q("l06_curve_band", lambda s, d: rounded(L.curve_band(latest(s, d))),
  "SELECT arm, epoch, count(*) AS seeds, round(avg(metric), 6) AS mean, round(stddev_samp(metric), 6) AS sd FROM latest GROUP BY ALL")
q("l07_near_best", lambda s, d: rounded(L.near_best(latest(s, d))),
  """SELECT run_id, count(*) FILTER (metric >= b - 0.01::DOUBLE) AS near_best, max(b) AS best, arg_max(metric, epoch) AS last,
 round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6, 1) AS minutes FROM (SELECT *, max(metric) OVER (PARTITION BY run_id) AS b FROM latest) GROUP BY ALL""")
q("l08_curve_report", lambda s, d: rounded(L.curve_report(latest(s, d), "full", ["blend", "jitter", "plain"])[0]),
  """SELECT c.arm, count(*) AS seeds, max(epochs) AS epochs, round(avg(last), 6) AS last_mean, round(stddev_samp(last), 6) AS last_sd,
 round(avg(mean_all), 6) AS all_epoch_mean, round(stddev_samp(mean_all), 6) AS all_epoch_sd, min(selected_epoch) AS selected_min,
 median(selected_epoch) AS selected_median, max(selected_epoch) AS selected_max FROM crv c JOIN sel USING (run_id) GROUP BY ALL""")
q("l08_curve_tests", lambda s, d: rounded(L.curve_report(latest(s, d), "full", ["blend", "jitter", "plain"])[1]),
  f"SELECT statistic, comparator, test, {WELCH}, round(p_holm, 6) AS p_holm FROM wh", **welch("curv", "statistic, comparator"),
  wh="""SELECT *, max(st) OVER (PARTITION BY statistic ORDER BY p, comparator ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *, least(1.0, (count(*) OVER (PARTITION BY statistic)
 - row_number() OVER (PARTITION BY statistic ORDER BY p, comparator) + 1) * p) AS st FROM wp)""",
  curv="""SELECT statistic, comparator, CASE arm WHEN 'full' THEN 'a' ELSE 'b' END AS side, value FROM (SELECT arm, unnest(['last', 'mean']) AS statistic, unnest([last, mean_all]) AS value
 FROM crv), (VALUES ('blend'), ('jitter'), ('plain')) c(comparator) WHERE arm IN ('full', comparator)""")
IN_SQL = {"mean": "avg", "max": "max", "min": "min"}
EPR = "SELECT run_id, epoch, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS epoch_s, count(*) AS samples, " + ", ".join(
    f"{IN_SQL[how]}({g})" + (f" FILTER (phase = '{phase}')" if phase else "") + f" AS {name}" for name, g, phase, how, _ in L.GAUGE_COLUMNS
) + " FROM resource_sample GROUP BY ALL"
PHT = """SELECT run_id, epoch, phase, sum(step_ms)::BIGINT AS busy_ms, sum(wait_ms)::BIGINT AS wait_ms, count(*) AS steps, sum(wait_ms) / nullif(sum(step_ms), 0)
 AS wait_frac, sum(step_ms) / count(*) AS step_ms FROM resource_sample GROUP BY ALL"""
STEP_SQL = {"busy_s": "busy_ms / 1000.0::DOUBLE", "steps": "steps", "step_ms": "step_ms", "wait_step_ms": "wait_ms / steps", "wait_frac": "wait_frac"}
ROWS = "SELECT e.*, " + ", ".join(f"max({STEP_SQL[m]}) FILTER (phase = '{p}') AS {name}" for name, p, m, _ in L.STEP_COLUMNS) + \
    " FROM epr e JOIN pht USING (run_id, epoch) GROUP BY ALL"
STEADY = [k for k, v in L.SUMMARY.items() if v == "steady mean"]
MEANS = ", ".join(f"CASE WHEN count(*) FILTER (epoch > 1) > 0 THEN avg({k}) FILTER (epoch > 1) ELSE avg({k}) END AS {k}" for k in STEADY)
SUMM = f"""SELECT *, greatest(torch_reserved_peak_gb, gpu_mem_peak_gb) AS vram_peak_gb FROM (SELECT regexp_replace(run_id, '_seed\\d+$', '') AS "group",
 count(DISTINCT run_id) AS runs, count(*) AS epochs, {MEANS}, {", ".join(f"{v}({k}) AS {k}" for k, v in L.SUMMARY.items() if v in ("max", "min"))} FROM rrows GROUP BY ALL)"""
RC = dict(epr=EPR, pht=PHT, rrows=ROWS, summ=SUMM)
FR = ["epoch_s", *[c[0] for c in L.GAUGE_COLUMNS if c[3] == "mean"]]
RFR = [*FR, *[c[0] for c in L.STEP_COLUMNS if c[2] != "steps"]]
MEMORY = """CASE WHEN vram_peak_gb < 0.5::DOUBLE * gpu_mem_total_gb THEN 'vram headroom' END, CASE WHEN ram_avail_min_gb < 0.1::DOUBLE * ram_total_gb
 THEN 'ram near limit' END, CASE WHEN shm_used_peak_gb > 0.8::DOUBLE * shm_total_gb THEN 'shm near limit' END, CASE WHEN sys_cpu_mean > 90 THEN 'cpu saturated' END"""
q("l09_epoch_rows", lambda s, d: rounded(L.resource_rows(V.resource_sample(s, d))),
  f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in RFR)}) FROM rrows", **RC)
q("l09_epoch_resources", lambda s, d: rounded(L.epoch_resources(V.resource_sample(s, d))),
  f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in FR)}) FROM epr", **RC)
q("l10_phase_timing", lambda s, d: rounded(L.phase_timing(V.resource_sample(s, d))),
  "SELECT * REPLACE (round(wait_frac, 6) AS wait_frac, round(step_ms, 6) AS step_ms) FROM pht", **RC)
q("l11_resource_summary", lambda s, d: rounded(L.resource_summary(L.resource_rows(V.resource_sample(s, d)))),
  f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in STEADY)}) FROM summ", **RC)
q("l12_bottlenecks", lambda s, d: L.bottlenecks(L.resource_summary(L.resource_rows(V.resource_sample(s, d)))).select(
    "group", "vram_peak_gb", "gpu_mem_total_gb", F.concat_ws("; ", "flags").alias("flags")),
  f"""SELECT "group", vram_peak_gb, gpu_mem_total_gb, array_to_string(list_filter([CASE WHEN gpu_util_train < 70 AND train_wait_frac > 0.2::DOUBLE THEN 'input-bound' END,
 CASE WHEN val_wait_frac > 0.2::DOUBLE THEN 'val input-bound' END, {MEMORY}], lambda x: x IS NOT NULL), '; ') AS flags FROM summ""", **RC)


def durations(s, d):
    plan = V.duration_log(s, d).select("stage", "cell").groupBy("stage").agg(
        (F.count(F.lit(1)) + F.countDistinct("cell")).alias("planned"))
    return rounded(L.duration_report(V.duration_log(s, d), plan))


q("l13_duration_report", durations,
  """SELECT stage, ran, skipped, failed, round(seconds, 6) AS seconds, greatest(planned - ran - skipped, 0) AS remaining,
 round(CASE WHEN planned - ran - skipped > 0 THEN mean_ok * (planned - ran - skipped) END, 6) AS eta_seconds FROM (SELECT stage,
 count(*) FILTER (status = 'ok') AS ran, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status IN ('failed', 'interrupted')) AS failed,
 sum(seconds) AS seconds, avg(seconds) FILTER (status = 'ok') AS mean_ok, count(*) + count(DISTINCT cell) AS planned FROM duration_log GROUP BY ALL)""")


def run_values(s, d):
    return M.brier(V.prediction(s, d), RUN).select(*RUN, F.col("brier").alias("value"))


VAL = dict(val=f"SELECT {R}, avg((p-y)*(p-y)) AS value FROM prediction GROUP BY ALL")
q("l14_paired_effects", lambda s, d: rounded(L.paired_effects(run_values(s, d), "full")),
  """SELECT cohort, arm, count(*) AS pairs, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, count(*) FILTER (d > 0) AS positive FROM (
 SELECT v.cohort, v.arm, r.value - v.value AS d FROM val v JOIN val r ON r.arm = 'full' AND v.arm <> 'full' AND r.cohort = v.cohort AND r.seed = v.seed)
 GROUP BY ALL""", **VAL)
CHANGES = [(0, "full", {}), (1, "plain", {"opt.lr": "0.002"}), (2, "jitter", {"opt.ema": "0.998", "aug.prob": "0.5"}), (3, "blend", {"aug.mix": "True"})]


def candidates(s, d):
    c = s.createDataFrame(CHANGES, "position int, arm string, overrides map<string,string>")
    return rounded(L.candidate_summary(latest(s, d), c))


q("l15_candidate_summary", candidates,
  """SELECT position, run_id, s.arm, s.seed, s.metric AS best, selected_epoch AS best_epoch, last, near_best, epochs, change FROM sel s
 JOIN (SELECT run_id, count(*) FILTER (metric >= b - 0.01::DOUBLE) AS near_best, arg_max(metric, epoch) AS last, count(*) AS epochs FROM (SELECT *,
 max(metric) OVER (PARTITION BY run_id) AS b FROM latest) GROUP BY ALL) USING (run_id) JOIN (VALUES (0, 'full', 'current recipe'),
 (1, 'plain', 'lr=0.002'), (2, 'jitter', 'ema=0.998 prob=0.5'), (3, 'blend', 'mix=True')) t(position, arm, change) ON t.arm = s.arm""")


def results(s, d):
    at = T.metrics_at_rules(V.prediction(s, d), [0.5, "val_youden"])
    sel = L.selected_epoch(latest(s, d), ["arm", "seed"]).select("arm", F.col("seed").cast("int").alias("seed"), "selected_epoch", "metric")
    return rounded(L.result_table(at, sel, V.COHORTS))


Q["l16_result_table"] = (results, sql("""SELECT arm, seed, rule, max(round(macro_f1, 6)) FILTER (cohort = 'val') AS val, max(round(macro_f1, 6))
 FILTER (cohort = 'testa') AS testa, max(round(macro_f1, 6)) FILTER (cohort = 'testb') AS testb, max(s.selected_epoch) AS selected_epoch, max(s.metric) AS metric
 FROM atrules a JOIN (SELECT arm, seed::INT AS seed, selected_epoch, metric FROM sel) s USING (arm, seed) WHERE rule <> 'prior_shift' GROUP BY ALL""",
    recursive=True, **{**TC, **C}))
q("l17_upsert", lambda s, d: rounded(L.upsert(run_values(s, d), run_values(s, d).filter("arm = 'full'").withColumn(
    "value", F.col("value") + 1.0).union(run_values(s, d).filter("seed = 0").withColumn("arm", F.lit("extra"))), RUN)),
  """SELECT cohort, arm, seed, round(CASE WHEN arm = 'full' THEN value + 1 ELSE value END, 6) AS value FROM val
 UNION ALL SELECT cohort, 'extra', seed, round(value, 6) FROM val WHERE seed = 0""", **VAL)
KIND = [("blend", "full", "add"), ("jitter", "full", "drop"), ("plain", "full", "lr"), ("full", "plain", "lr")]


def deltas(s, d):
    rows = run_values(s, d).filter("cohort = 'val'").select(F.col("arm").alias("candidate"), "seed", F.col("value").alias("auc"))
    j = run_values(s, d).filter("cohort = 'testa'").select(F.col("arm").alias("candidate"), "seed", F.col("value").alias("j"))
    c = s.createDataFrame(KIND, "candidate string, reference string, kind string")
    return L.candidate_deltas(rows.join(j, ["candidate", "seed"]), c, ["auc", "j"])


DEL = """SELECT k.candidate, k.reference, kind, count(*) AS seeds, round(avg(a.value - ra.value), 4) AS d_auc, round(avg(b.value - rb.value), 4) AS d_j FROM
 (VALUES ('blend', 'full', 'add'), ('jitter', 'full', 'drop'), ('plain', 'full', 'lr'), ('full', 'plain', 'lr')) k(candidate, reference, kind)
 JOIN val a ON a.arm = candidate AND a.cohort = 'val' JOIN val b ON b.arm = candidate AND b.cohort = 'testa' AND b.seed = a.seed
 JOIN val ra ON ra.arm = reference AND ra.cohort = 'val' AND ra.seed = a.seed JOIN val rb ON rb.arm = reference AND rb.cohort = 'testa' AND rb.seed = a.seed
 GROUP BY ALL"""
q("l18_candidate_deltas", deltas, "SELECT * FROM del", **{**VAL, "del": DEL})
VER = """SELECT *, CASE kind WHEN 'lr' THEN CASE WHEN d_auc >= 0.005 AND d_j >= -0.005 THEN 'eligible' ELSE 'keep base' END
 WHEN 'add' THEN CASE WHEN d_j >= 0.005 AND d_auc >= -0.005 THEN 'adopt' WHEN d_j <= -0.005 OR d_auc <= -0.005 THEN 'reject' ELSE 'inconclusive: keep off' END
 ELSE CASE WHEN d_j <= -0.005 OR d_auc <= -0.005 THEN 'keep component' WHEN d_j >= 0.005 AND d_auc >= -0.005 THEN 'drop component'
 ELSE 'inconclusive: keep on' END END AS v FROM del"""
q("l19_verdict", lambda s, d: L.verdict(deltas(s, d), "d_auc", "d_j"),
  """SELECT * EXCLUDE (v), CASE WHEN v <> 'eligible' THEN v WHEN row_number() OVER (PARTITION BY v ORDER BY d_auc DESC, candidate) = 1 THEN 'adopt'
 ELSE 'eligible, not best' END AS verdict FROM ver""", **{**VAL, "del": DEL, "ver": VER})
q("l20_adopt", lambda s, d: rounded(L.adopt(run_values(s, d).select(F.col("arm").alias("candidate"), F.col("value").alias("score")), "full")),
  """SELECT CASE WHEN b >= r + 0.01::DOUBLE THEN best ELSE 'full' END AS chosen, best, round(b, 6) AS best_score, round(r, 6) AS reference_score FROM (SELECT
 arg_max(arm, s) AS best, max(s) AS b, max(s) FILTER (arm = 'full') AS r FROM (SELECT arm, avg(value) AS s FROM val GROUP BY ALL))""", **VAL)
q("l21_grid_best", lambda s, d: L.grid_best(latest(s, d), ["run_id"], "loss", "epoch"),
  "SELECT run_id, arg_max(epoch, (loss, epoch)) AS best, max(loss) AS loss FROM latest GROUP BY ALL")
q("l22_paired_means", lambda s, d: rounded(L.paired_means(run_values(s, d).filter("NOT (arm = 'plain' AND seed = 2)"),
                                                          [("full", "plain"), ("blend", "jitter")])),
  """SELECT a.cohort, a.arm AS with_arm, b.arm AS without_arm, count(*) AS seeds, round(avg(a.value), 6) AS mean_with, round(avg(b.value), 6) AS mean_without,
 round(avg(a.value - b.value), 6) AS difference FROM val a JOIN val b USING (cohort, seed) WHERE (a.arm, b.arm) IN (('full', 'plain'), ('blend', 'jitter'))
 AND NOT (b.arm = 'plain' AND seed = 2) GROUP BY ALL""", **VAL)
q("l23_class_scores", lambda s, d: L.class_scores(V.train_log(s, d)),
  """SELECT run_id, epoch, arrival, 'neg' AS class_name, neg_score AS score FROM train_log UNION ALL SELECT run_id, epoch, arrival, 'pos', pos_score FROM train_log""")
_ = table
