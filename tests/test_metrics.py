import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.functions.columns import clip, score_bin
from evalspark.functions.student import quantile975, two_sided
from evalspark.operators import infer as B
from evalspark.operators import metrics as M
from evalspark.operators import thresholds as T
from evalspark.plans.prefix import exact_quantiles, order_code


def frame(spark, y, p, run="r"):
    return spark.createDataFrame([(run, i, a, float(b)) for i, (a, b) in enumerate(zip(y, p))], "run string, item_id int, y int, p double")


def test_hand_values(spark):
    P = frame(spark, [0, 0, 1, 1, 1], [.1, .4, .35, .8, .4])
    assert M.roc_auc(P, ["run"]).first()["roc_auc"] == 0.75
    assert abs(M.average_precision(P, ["run"]).first()["average_precision"] - 0.805556) < 1e-6
    both = M.ranking_metrics(P, ["run"]).first()
    assert both["roc_auc"] == 0.75


def test_one_class_and_missing_score_give_null(spark):
    assert M.roc_auc(frame(spark, [1, 1], [.1, .2]), ["run"]).first()["roc_auc"] is None
    assert M.roc_auc(frame(spark, [0, 1], [.1, float("nan")]), ["run"]).first()["roc_auc"] is None


def test_area_is_symmetric_and_matches_brute_force_on_odd_numbers(spark):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.normal(0, 1e-12, 300), rng.normal(0, 1e6, 300), [0.0, -0.0, 5e-324, -1e300, 1e300], rng.normal(0.9999999, 1e-9, 200)])
    y = rng.integers(0, 2, len(p))
    want = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    P = frame(spark, y.tolist(), p)
    got = M.roc_auc(P, ["run"]).first()["roc_auc"]
    flipped = M.roc_auc(P.withColumn("p", -F.col("p")), ["run"]).first()["roc_auc"]
    assert abs(got - want) < 1e-12 and abs(got + flipped - 1.0) < 1e-12
    assert abs(M.ranking_metrics(P, ["run"]).first()["roc_auc"] - want) < 1e-12


def test_order_code_is_monotone(spark):
    rng = np.random.default_rng(1)
    x = np.sort(np.concatenate([rng.normal(size=2000), rng.normal(size=2000) * 1e-9, 2.0 ** np.arange(-60, 60), -(2.0 ** np.arange(-60, 60))]))
    hi, lo = order_code("x")
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", hi.alias("h"), lo.alias("l")).collect()
    codes = [(r["h"], r["l"]) for r in sorted(rows, key=lambda r: r["x"])]
    assert codes == sorted(codes)


def test_exact_quantiles(spark):
    x = np.random.default_rng(2).normal(size=501)
    got = exact_quantiles(spark.createDataFrame([(float(v),) for v in x], "x double"), [], "x", {"a": 0.1, "b": 0.5, "c": 0.977}).first()
    assert np.allclose(list(got), np.quantile(x, [0.1, 0.5, 0.977]), atol=1e-12)


def test_bins_follow_literal_edges(spark):
    got = frame(spark, [0, 0, 0], [.3, .6, .7]).select(score_bin("p").alias("b")).collect()
    assert [r["b"] for r in got] == [2, 5, 6]


def test_clip_keeps_null(spark):
    assert spark.createDataFrame([(None,)], "p double").select(clip("p", 0.1, 0.9).alias("c")).first()["c"] is None


def test_holm_and_single_seed(spark):
    d = spark.createDataFrame([("f", "a", .01), ("f", "b", .04), ("f", "c", .03)], "fam string, k string, p double")
    got = {r["k"]: r["p_holm"] for r in B.holm(d, ["fam"], "p", ["k"]).collect()}
    assert np.allclose([got["a"], got["b"], got["c"]], [.03, .06, .06])
    one = spark.createDataFrame([("x", 0.5)], "g string, m double")
    assert M.seed_summary(one, ["g"], ["m"]).first()["m_sd"] is None


def test_draws_sum_to_the_stratum_and_a_unit_must_not_mix(spark):
    P = spark.createDataFrame([("c", i % 2, f"u{i % 2}_{i // 6}", "a", 0, i, 0.1) for i in range(60)],
                              "cohort string, y int, unit string, arm string, seed int, item_id int, p double")
    U = B.units(P)
    n = {r["y"]: r["n"] for r in U.select("y", "n").distinct().collect()}
    for r in B.draw_units(U, 7).groupBy("y", "draw").agg(F.sum("weight").alias("w")).collect():
        assert r["w"] == n[r["y"]]
    B.guard_units(P).count()
    with pytest.raises(Exception, match="mix classes"):
        B.guard_units(P.withColumn("unit", F.lit("all"))).select("y").collect()


def test_student_tail():
    assert abs(two_sided(2.7764451, 4) - 0.05) < 1e-7 and abs(quantile975(1) - 12.7062047) < 1e-6
    assert abs(quantile975(30) - 2.0422725) < 1e-6 and math.isnan(two_sided(1.0, 0))


def test_temperature_is_the_minimum_and_leaves_the_ranking(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=400) * 3
    y = (rng.random(400) < 1 / (1 + np.exp(-z / 2.5))).astype(int)
    P = frame(spark, y.tolist(), 1 / (1 + np.exp(-z)))
    t = T.fit_temperature(P, ["run"]).first()
    grid = np.exp(np.linspace(-5, 5, 200001))
    zz = np.log(np.clip(1 / (1 + np.exp(-z)), 1e-6, 1 - 1e-6) / (1 - np.clip(1 / (1 + np.exp(-z)), 1e-6, 1 - 1e-6)))
    loss = [np.mean(np.logaddexp(0, zz / g) - y * zz / g) for g in grid[::200]]
    assert abs(math.log(t["temperature"]) - math.log(grid[::200][int(np.argmin(loss))])) < 0.02 and not t["at_bound"]


def test_prior_shift_follows_the_plain_recurrence(spark):
    p = np.random.default_rng(4).beta(2, 5, 300)
    pi = 0.5
    for _ in range(1000):
        q = (p * pi / .5) / (p * pi / .5 + (1 - p) * (1 - pi) / .5)
        if abs(q.mean() - pi) < 1e-6:
            break
        pi = q.mean()
    got = T.prior_shift(frame(spark, [0] * 300, p), ["run"]).first()
    assert abs(got["prior"] - pi) < 1e-9 and abs(got["threshold"] - (1 - pi)) < 1e-9
