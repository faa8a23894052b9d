"""Plans that must hold up on tables that are larger than Spark's estimate of them."""

import re
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators import confound as X
from evalspark.operators import curate as C
from evalspark.operators import fuse
from evalspark.operators import infer as B
from evalspark.operators import metrics as M
from evalspark.plans import vectors as V
from evalspark.queries import REGISTRY
from evalspark.sources import views
from evalspark.streaming import stream as W


def broadcasts(df) -> list[str]:
    """The joins whose plan broadcasts a side, before any row is read."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [line.strip() for line in plan.splitlines() if "BroadcastHashJoin" in line]


def test_scores_made_by_a_generator_are_not_broadcast(spark):
    names = F.explode(F.array(F.lit("original"), F.lit("none"), F.lit("other0"), F.lit("same0")))
    S = spark.range(50).select(F.col("id").alias("item_id"), (F.col("id") % 2).cast("int").alias("y"), F.lit("c").alias("cohort"),
                               F.lit("a").alias("arm"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seed")).withColumn("condition", names)
    S = S.withColumn("p", F.pmod(F.xxhash64("item_id", "seed", "condition"), F.lit(100)) / 100.0)
    on = ["cohort", "arm", "seed", "item_id"]
    t = M.drop_increase(S.filter("condition = 'original'"), S.filter("condition = 'none'"), on, on[:3])
    assert not broadcasts(t) and t.count() == 3
    t = X.swap_effects(S)
    assert not [j for j in broadcasts(t) if "item_id" in j] and t.count() == 3


def test_units_may_have_any_name(spark):
    rows = [("c", f"a{a}", s, i, f"u{i % 4}", "k", i % 2, ((i * 7 + a + s) % 10) / 10.0) for a in range(2) for s in range(2) for i in range(20)]
    P = spark.createDataFrame(rows, "cohort string, arm string, seed int, item_id int, unit string, subtype string, y int, p double")
    own = {r["unit"]: r["total"] for r in B.draw_units(B.units(P), 5).groupBy("unit").agg(F.sum("weight").alias("total")).collect()}
    for name in ("block", "entries", "local"):
        drawn = B.draw_units(B.units(P.withColumnRenamed("unit", name), unit=name), 5, unit=name)
        assert {r[name]: r["total"] for r in drawn.groupBy(name).agg(F.sum("weight").alias("total")).collect()} == own
    blocks = P.select("item_id", F.concat(F.lit("b"), F.col("item_id") % 5).alias("block")).distinct()
    assert B.unit_sensitivity(P, blocks, "a0", ["a1"], 5).count() == 2


@pytest.mark.parametrize("sums", [0, 4])
def test_a_task_sends_a_score_once_unless_its_sums_are_full(spark, monkeypatch, sums):
    monkeypatch.setattr(V, "SUMS", sums)
    monkeypatch.setattr(V, "CELLS", 400)
    rows = [("c", f"a{i % 3}", i % 2, (i % 50) / 50.0 if i % 49 else float("nan"), V.as_binary(np.full((1, 5), i % 7, np.int16))[0].as_py()) for i in range(6000)]
    cells = spark.createDataFrame(rows, "cohort string, arm string, y int, p double, w binary").coalesce(1)
    found = V.score_vectors(cells, ["cohort", "arm"], 4).collect()
    total = {}
    for r in found:
        assert (r["pos"] is None) != (r["neg"] is None)
        key = r["arm"], int(r["pos"] is not None), str(r["p"])
        total[key] = total.get(key, 0) + V.counts_matrix(V.pa.array([r["pos"] or r["neg"]]), 5)[0]
    want = {}
    for _, arm, y, p, w in rows:
        want[arm, y, str(p)] = want.get((arm, y, str(p)), 0) + np.frombuffer(w, np.int16).astype(int)
    assert total.keys() == want.keys() and all((total[k] == want[k]).all() for k in want)
    assert len(found) == len(want) if sums else len(found) > len(want)


def test_a_line_of_a_log_does_not_carry_its_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b,a\nx,1\ny,2\n")
    batch = SimpleNamespace(readStream=spark.read)  # the plan of a stream shows only once it runs
    plan = W.stream_log(batch, str(tmp_path), T.StructType.fromDDL("a int, b string"))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate explode\(lines#\d+\), \[\d+\]", plan)  # the array is not among the columns that go on


def exchanged_after_a_generator(df) -> list[str]:
    """Exchanges that stand above a generator, so that they move the repeated rows."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" +-:*()0123456789")) for line in plan]
    found = []
    for i, line in enumerate(plan):
        below = []
        for j in range(i + 1, len(plan)):
            if depth[j] <= depth[i]:
                break
            below.append(plan[j])
        if "Exchange" in line and any("Generate" in b for b in below):
            found.append(line.strip())
    return found


@pytest.fixture
def lines(spark, tmp_path):
    orders = "o_orderkey bigint, o_custkey bigint, o_orderstatus string"
    spark.createDataFrame([(i, i % 3, "FOP"[i % 3]) for i in range(30)], orders).write.parquet(f"{tmp_path}/orders.parquet")
    line = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double"
    rows = [(i % 24, i, i % 5, i % 4, float(i), 0.01) for i in range(90)]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("how", ["mean", "max", "frac"])
def test_instance_scores_of_a_bag_meet_before_they_are_repeated(spark, lines, how):
    t = REGISTRY[f"f03_bag_{how}"][0](spark, lines)
    assert not exchanged_after_a_generator(t)
    assert t.count() == 24 * 12


@pytest.mark.parametrize("name", ["c06_greedy_iou_dedup", "c12_keep_one_per_entity", "c17_manifest_diff", "c18_key_differences"])
def test_boxes_are_not_searched_for_conflicts_that_nobody_reads(spark, tmp_path, monkeypatch, name):
    line = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, l_linestatus string"
    rows = [(i % 24, i, i % 5, i % 4, "ANR"[i % 3], "FO"[i % 2]) for i in range(90)]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    asked = []
    monkeypatch.setattr(C, "flag_conflicts", lambda boxes, real=C.flag_conflicts: asked.append(1) or real(boxes))
    assert REGISTRY[name][0](spark, str(tmp_path)).count() > 0
    assert not asked


def test_features_are_joined_without_their_texts_and_an_audit_reads_them_once(spark, folder):
    plan = views.features(spark, folder)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    assert "f3" in plan.output().mkString(",") and "text#" not in plan.output().mkString(",")

    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        read.add(1)
        return v

    rows = [(i, int((i * 7 + i // 5) % 10 < 5 + i % 3), "ab"[i % 2], i % 7 / 7.0, None if i % 11 == 0 else i % 5 / 5.0) for i in range(110)]
    Fr = spark.createDataFrame(rows, "item_id int, y int, part string, f1 double, f2 double").withColumn("f1", seen("f1"))
    found = {r["part"]: (r["n"], r["dropped"]) for r in X.transfer_audit(Fr, "part", "a", ["f1", "f2"]).collect()}
    assert found == {"a": (50, 5), "b": (50, 5), "a (cross-validated)": (None, None)} and read.value == len(rows)


def test_shifts_of_swaps_are_those_of_the_pairs_without_a_join(spark):
    rng = np.random.default_rng(4)
    rows = [("a", s, i, c, int(i % 3 > 0), None if rng.random() < 0.1 else float(rng.integers(0, 1000)) / 1000)
            for s in range(2) for i in range(40) for c in ("original", "none", "other0", "other1", "same0") for _ in range(rng.integers(0, 3))]
    rows += [("a", 0, None, "original", 1, 0.5), ("a", 0, None, "other0", 1, 0.25), ("a", 0, 90, "other0", 1, 0.25), (None, 0, 3, "same0", 1, 0.25)]
    S = spark.createDataFrame(rows, "arm string, seed int, item_id int, condition string, y int, p double")
    t = X.swap_effects(S, ["arm", "seed"])
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "item_id" in line]
    got = {(r["arm"], r["seed"]): (r["dp_towards_other_other"], r["dp_towards_other_same"]) for r in t.collect()}
    for seed in range(2):
        means = {}
        for c in ("other0", "other1", "same0"):
            d = [(o[5] - m[5]) * (1 if m[4] == 1 else -1) for m in rows for o in rows if o[3] == "original" and m[3] == c and o[1] == m[1] == seed
                 and o[0] == m[0] == "a" and o[2] == m[2] is not None and o[5] is not None and m[5] is not None]
            means.setdefault(c[:-1], []).append(sum(d) / len(d))
        assert got["a", seed] == pytest.approx((np.mean(means["other"]), np.mean(means["same"])), abs=1e-12)
    assert got[None, 0] == (None, None)
    assert X.swap_effects(S.filter("condition = 'original'"), ["arm", "seed"]).first()["dp_towards_other_same"] is None


def test_bags_are_scored_in_one_reading_of_their_instances(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        read.add(1)
        return v

    rng = np.random.default_rng(2)
    rows = [("a", s, i, None if i % 9 == 8 else float(rng.integers(0, 1000)) / 1000) for s in range(2) for i in range(30) for _ in range(i % 6)]
    whole = [("a", s, i, i % 2, 0.25) for s in range(2) for i in range(30)]
    I = spark.createDataFrame(rows, "arm string, seed int, item_id int, p double").withColumn("p", seen("p"))
    P = spark.createDataFrame(whole, "arm string, seed int, item_id int, y int, p double")
    got = {r["scoring"]: r["auc_mean"] for r in fuse.compare_scorings(I, P, 2).collect()}
    assert read.value == len(rows)
    for name, score in (("whole", None), ("mean", np.mean), ("max", max), ("topk", lambda v: np.mean(sorted(v)[-2:]))):
        aucs = []
        for seed in range(2):
            bag = {i: [r[3] for r in rows if r[1] == seed and r[2] == i and r[3] is not None] for i in range(30)}
            p = {i: round(float(score(v)), 12) if score and v else 0.25 for i, v in bag.items()}
            pairs = [(p[i] > p[j]) + (p[i] == p[j]) / 2 for i in p for j in p if i % 2 == 1 and j % 2 == 0]
            aucs.append(np.mean(pairs))
        assert got[name] == pytest.approx(np.mean(aucs), abs=1e-12)


def test_a_manifest_judges_its_boxes_once(spark, monkeypatch):
    judged, real = spark.sparkContext.accumulator(0), C.greedy_iou_dedup

    @F.udf("boolean")
    def seen(kept):
        judged.add(1)
        return kept

    monkeypatch.setattr(C, "greedy_iou_dedup", lambda d: real(d).withColumn("kept", seen("kept")))
    rows = [("p", f"f{i % 2}", "s", f"i{i % 2}", "ALL", "blast", 40.0 * (i // 4 % 8) + 10, 40.0 * (i // 32) + 10, 16.0, 16.0, 640, 640, i, "a.json") for i in range(64)]
    raw = spark.createDataFrame(rows, "image_path string, file_name string, slide string, image string, leukemia_type string, category string, "
                                      "x double, y double, w double, h double, img_w int, img_h int, annotation_id bigint, source_json string")
    same = spark.createDataFrame([], "file_name string, x double, y double, w double, h double, cell_group string")
    found = C.build_manifest(raw, same, {"lymph": 0, "blast": 1}, {0: ["blast"], 1: ["lymph"]}).collect()
    assert [r["annotation_id"] for r in found] == sorted((i for i in range(64) if i % 4 < 2), key=lambda i: f"ALL/s_i{i % 2}_{i}.png")
    assert judged.value == 32
