import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.functions.fingerprint import both_hashes, view_index
from evalspark.operators import bank as N
from evalspark.operators import confound as X
from evalspark.operators import curate as C
from evalspark.operators import dedup as D
from evalspark.operators import fuse as U
from evalspark.operators import runlog as L
from evalspark.plans.components import connected_components
from evalspark.plans.groups import join_groups, join_skewed, rank_rows
from evalspark.sources import io as S
from evalspark.streaming import stream as W


def brute_boxes(rows, thr):
    kept, out = {}, {}
    for f, i, x, y, w, h in sorted(rows):
        hit = False
        for a, b, c, d in kept.get(f, []):
            inter = max(0, min(x + w, a + c) - max(x, a)) * max(0, min(y + h, b + d) - max(y, b))
            hit |= inter / (w * h + c * d - inter) > thr
        if not hit:
            kept.setdefault(f, []).append((x, y, w, h))
        out[i] = not hit
    return out


@pytest.mark.parametrize("fold_rows,thr", [(5000, 0.5), (10, 0.5), (10, 0.3)])
def test_greedy_dedup_walk_and_rounds_match_brute_force(spark, fold_rows, thr):
    rng = np.random.default_rng(5)
    rows = [("f%d" % (i % 3 == 0), i, *[float(v) for v in rng.integers(0, 60, 2)], *[float(v) for v in rng.integers(8, 40, 2)]) for i in range(240)]
    df = spark.createDataFrame(rows, "file_name string, annotation_id int, x double, y double, w double, h double")
    df = df.withColumns({"label": F.lit(1), "source_json": F.lit("a")})
    got = {r["annotation_id"]: r["kept"] for r in C.greedy_iou_dedup(df, thr, fold_rows=fold_rows).collect()}
    assert got == brute_boxes(rows, thr)


@pytest.mark.parametrize("fold_rows", [5000, 10])
def test_radius_suppression_matches_brute_force(spark, fold_rows):
    rng = np.random.default_rng(6)
    rows = [(i % 2, i, float(rng.integers(0, 80)), float(rng.integers(0, 80)), float(rng.integers(1, 20))) for i in range(160)]
    want = set()
    for g in (0, 1):
        kept = []
        for _, i, x, y, r in sorted((t for t in rows if t[0] == g), key=lambda t: (-t[4], -t[2], -t[3], t[1])):
            if all(np.hypot(x - a, y - b) > 0.8 * (r + c) for a, b, c in kept):
                kept.append((x, y, r))
                want.add(i)
    df = spark.createDataFrame(rows, "item_id int, inst_id int, x double, y double, r double")
    assert {r["inst_id"] for r in C.radius_nms(df, ["item_id"], fold_rows=fold_rows).collect()} == want


@pytest.mark.parametrize("fold_rows", [5000, 2])
def test_degenerate_geometry_is_kept_in_groups_of_every_size(spark, fold_rows):
    nan, inf = float("nan"), float("inf")
    odd = [(1.0, 1.0, 0.0, 5.0)] * 2 + [(1.0, 1.0, nan, 5.0)] * 2 + [(None, 1.0, 4.0, 5.0), (1.0, 1.0, inf, 5.0), (1.0, 1.0, -3.0, -3.0)]
    rows = [("f", "a", 1, i, *g) for i, g in enumerate([*odd, *[(1.0, 1.0, 4.0, 5.0)] * 3])]
    df = spark.createDataFrame(rows, "file_name string, source_json string, label int, annotation_id int, x double, y double, w double, h double")
    got = {r["annotation_id"]: r["kept"] for r in C.greedy_iou_dedup(df, fold_rows=fold_rows).collect()}
    assert got == {i: i <= 7 for i in range(10)}
    discs = [(1, i, *g) for i, g in enumerate([(0.0, 0.0, nan), (0.0, None, 1.0), (0.0, 0.0, -1.0), *[(0.0, 0.0, 2.0)] * 3])]
    t = spark.createDataFrame(discs, "item_id int, inst_id int, x double, y double, r double")
    assert {r["inst_id"] for r in C.radius_nms(t, ["item_id"], fold_rows=fold_rows).collect()} == {0, 1, 2, 3}


def test_log_columns_go_by_the_header_and_a_failed_write_keeps_the_result(spark, tmp_path):
    from pyspark.sql import types as T

    files = {"a": "run_id,metric,loss\nr1,0.8,0.2\n", "b": "loss,run_id,metric\n0.3,r2,NaN\n0.4,torn\nx,r3,1\n0.1,r4,\n",
             "c": "run_id,loss\nr9,1\n", "d": "no header here\n"}
    for name, text in files.items():
        (tmp_path / "log").mkdir(exist_ok=True)
        (tmp_path / "log" / f"{name}.csv").write_text(text)
    schema = T._parse_datatype_string("run_id string, loss double, metric double")
    want = [("r1", 0.2, 0.8), ("r2", 0.3, None), ("r4", 0.1, None)]
    log = S.read_log(spark, str(tmp_path / "log"), schema)
    assert log.columns == ["run_id", "loss", "metric"] and sorted(map(tuple, log.collect())) == want
    W.run_to_table(W.stream_log(spark, str(tmp_path / "log"), schema), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want

    place = str(tmp_path / "result")
    S.write_result(spark.range(3), place)
    with pytest.raises(Exception, match="broken"):
        S.write_result(spark.range(5).withColumn("id", F.when(F.col("id") > 3, F.raise_error(F.lit("broken"))).otherwise(F.col("id"))), place)
    assert spark.read.parquet(place).count() == 3
    S.write_result(spark.range(4), place)
    assert spark.read.parquet(place).count() == 4 and sorted(p.name for p in tmp_path.glob("result*")) == ["result"]


def test_rank_and_joins_on_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("g"), (F.col("id") * 7919 % 5000).alias("v"))
    got = {(r["g"], r["v"]): r["rank"] for r in rank_rows(df, ["g"], ["v"]).collect()}
    for g in ("hot", "cold"):
        vs = sorted(v for k, v in got if k == g)
        assert [got[(g, v)] for v in vs] == list(range(1, len(vs) + 1))
    n = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))
    assert join_groups(df, n, ["g"]).count() == 5000
    split = join_skewed(df, n, ["g"], "n", limit=100)
    assert split.count() == 5000 and split.filter("m is null").count() == 0


def test_components_against_union_find(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(500, 600)]
    parent = {i: i for i in range(700)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(spark.range(700).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["node"]: r["component"] for r in got.collect()} == {i: root(i) for i in range(700)}


@pytest.mark.parametrize("bands", [8, 10])
def test_near_pairs_and_min_distance_are_exact(spark, bands):
    rng = np.random.default_rng(8)
    grids = rng.normal(size=(40, 64))
    views = view_index()
    near = grids[:15][:, views[3]] + rng.normal(size=(15, 64)) * 0.03
    src = ["a"] * 20 + ["b"] * 20 + ["c"] * 15
    everything = np.concatenate([grids, near])
    df = spark.createDataFrame([(s, i, [float(v) for v in g]) for i, (s, g) in enumerate(zip(src, everything))],
                               "source string, item_id int, grid array<double>")
    f = D.fingerprints(df).cache()
    h1 = np.stack([both_hashes(everything[:, v])[0] for v in views], 1).view(np.uint64)
    h2 = np.stack([both_hashes(everything[:, v])[1] for v in views], 1).view(np.uint64)
    hits, best = {}, {}
    for i, a in enumerate(src):
        for j, b in enumerate(src):
            if a < b:
                d1 = int(np.bitwise_count(h1[i] ^ h1[j, 0]).min())
                d2 = int(np.bitwise_count(h2[i] ^ h2[j, 0]).min())
                best[a, b] = min(best.get((a, b), 99), d1)
                hits[a, b] = hits.get((a, b), 0) + (d1 <= 6 and d2 <= 10)
    got = {(r[0], r[1]): r[2] for r in D.near_duplicates(f, bands=bands).collect()}
    assert got == {k: v for k, v in hits.items() if v} and sum(got.values()) > 0
    assert {(r[0], r[1]): r[2] for r in D.min_distance(f, block=7).collect()} == best


def test_guards_fire(spark):
    d = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "group_id string, y int")
    for bad, message in ((lambda: D.assert_unmixed(d).collect(), "mixes labels"), (lambda: C.assert_unique(d, ["group_id"]).collect(), "repeated"),
                         (lambda: C.assert_same_keys(d, d.filter("y = 0"), ["group_id"]).collect(), "differ"),
                         (lambda: C.assert_counts(d, {"a": 5, "b": 1}, "group_id").collect(), "counts")):
        with pytest.raises(Exception, match=message):
            bad()
    m = spark.createDataFrame([("a", "ALL", 3)], "item_id string, class_name string, group_id int")
    items = spark.createDataFrame([("a",), ("z",)], "item_id string")
    assert {r["unit"] for r in D.attach_units(items, m).collect()} == {"ALL_3", "solo_z"}
    with pytest.raises(Exception, match="no group for z"):
        D.attach_units(items, m, strict=True).collect()
    P = spark.createDataFrame([("c", "a", s, i, 1, 0.5) for s in (0, 1) for i in range(3) if (s, i) != (1, 2)],
                              "cohort string, arm string, seed int, item_id int, y int, p double")
    with pytest.raises(Exception, match="runs differ"):
        U.ensemble(P).collect()
    with pytest.raises(Exception, match="not aligned"):
        U.assert_aligned(P).collect()
    assert U.ensemble(P, strict=False).count() == 2


def test_blocks_and_bag_fallback(spark):
    b = D.contiguous_blocks(spark.range(10).withColumn("g", F.lit("x")), ["g"], ["id"], 4).groupBy("block").count().collect()
    assert sorted((r[0], r[1]) for r in b) == [(0, 3), (1, 3), (2, 2), (3, 2)]
    inst = spark.createDataFrame([(1, 0.2), (1, 0.6)], "item_id int, p double")
    whole = spark.createDataFrame([(1, 0.9), (2, 0.7)], "item_id int, p double")
    got = {r["item_id"]: r["p"] for r in U.bag_scores(inst, ["item_id"], "mean", fallback=whole).collect()}
    assert got == {1: 0.4, 2: 0.7}


def test_logistic_and_cross_validation(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.5, -1.0] + 0.3)))).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), f"u{i % 30}", float(x[i, 0]), float(x[i, 1])) for i in range(300)],
                               "item_id int, y int, unit string, a double, b double")
    beta = np.array(X.logistic(df.withColumn("m", F.lit(0)), ["m"], ["a", "b"]).first()["beta"])
    d = np.c_[np.ones(300), x]
    grad = d.T @ (1 / (1 + np.exp(-d @ beta)) - y) + np.array([0, *beta[1:]])
    assert np.abs(grad).max() < 1e-6
    assert 0.75 < X.cv_auc(df, ["a", "b"], "unit").first()["cv_auc"] < 0.95
    folds = X.assign_folds(df, groups="unit").groupBy("unit").agg(F.countDistinct("fold").alias("k")).agg(F.max("k")).first()[0]
    assert folds == 1


def test_bank_algebra(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(60, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, .5, .2]])
    df = spark.createDataFrame([(i, *[float(v) for v in r]) for i, r in enumerate(x)], "item_id bigint, a double, b double, c double")
    got = N.shrunk_cov(df, ["a", "b", "c"])
    c = x - x.mean(0)
    emp, p, n = c.T @ c / 60, 3, 60
    mu = np.trace(emp) / p
    beta = 1 / (p * n) * (((c ** 2).T @ (c ** 2)).sum() / n - (emp ** 2).sum())
    delta = ((emp ** 2).sum() - 2 * mu * np.trace(emp) + p * mu ** 2) / p
    s = min(beta, delta) / delta
    assert np.allclose(got["covariance"], (1 - s) * emp + s * mu * np.eye(p)) and abs(got["shrinkage"] - s) < 1e-9
    picks, dist = [0], np.linalg.norm(x - x[0], axis=1)
    for _ in range(4):
        picks.append(int(dist.argmax()))
        dist = np.minimum(dist, np.linalg.norm(x - x[picks[-1]], axis=1))
    rows = N.diverse_sample(df, ["a", "b", "c"], 5, 0, cut_every=2).orderBy("position").collect()
    assert [r["item_id"] for r in rows] == picks
    u, sv, vt = np.linalg.svd(c, full_matrices=False)
    axes = [v * np.sign(v[np.abs(v).argmax()]) for v in vt[:2]]
    sc = np.stack([c @ v for v in axes], 1)
    lo, hi = np.quantile(sc, 0.05, axis=0), np.quantile(sc, 0.95, axis=0)
    want = [int(np.linalg.norm(sc - t, axis=1).argmin()) for t in ((hi[0], 0), (lo[0], 0), (0, hi[1]), (0, lo[1]))]
    assert [r["item_id"] for r in N.axis_references(df, ["a", "b", "c"], 5.0).orderBy("target").collect()] == want


def test_matching_reaches_the_reference_moments(spark):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(i % 4, "a", 0, float(v)) for i, v in enumerate(rng.normal(2, 1, 200))], "item_id int, region string, channel int, value double")
    ref = spark.createDataFrame([("a", 0, 5.0, 1.5)], "region string, channel int, ref_mean double, ref_sd double")
    m = N.region_moments(N.moment_match(df, ref), value="matched").collect()
    assert all(abs(r["mean"] - 5.0) < 1e-9 and abs(r["sd"] - 1.5) < 1e-9 for r in m)


def test_log_rules(spark):
    s = spark.createDataFrame([("g", 50.0, 0.3, None, None, 1.0, 95.0, 10.0, 40.0, 100.0, 100.0), ("h", 90.0, 0.3, 0.3, 19.0, 20.0, 9.0, 90.0, 40.0, 100.0, 100.0)],
                              "group string, gpu_util_train double, train_wait_frac double, val_wait_frac double, vram_peak_gb double, ram_avail_min_gb double, "
                              "sys_cpu_mean double, shm_used_peak_gb double, gpu_mem_total_gb double, ram_total_gb double, shm_total_gb double")
    flags = {r["group"]: r["flags"] for r in L.bottlenecks(s).collect()}
    assert flags == {"g": ["input-bound", "ram near limit", "cpu saturated"], "h": ["val input-bound", "vram headroom", "shm near limit"]}


def test_annotation_name_is_checked_and_empty_class_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"images":[{"id":1,"file_name":"bad.png","width":9,"height":9}],"categories":[{"id":1,"name":"c"}],'
                                     '"annotations":[{"id":1,"image_id":1,"category_id":1,"bbox":[1,2,3,4]}]}')
    with pytest.raises(Exception, match="cannot parse"):
        S.read_annotations(spark, str(tmp_path / "x.json"), multiline=True).collect()
    for c in ("Normal", "ALL"):
        (tmp_path / "r" / c).mkdir(parents=True)
    (tmp_path / "r" / "ALL" / "1.png").write_bytes(b"x")
    (tmp_path / "r" / "ALL" / "._2.png").write_bytes(b"x")
    with pytest.raises(Exception, match="no files"):
        S.scan_labelled(spark, [str(tmp_path / "r")], ["Normal", "ALL"]).collect()
    (tmp_path / "r" / "Normal" / "3.png").write_bytes(b"x")
    assert S.scan_labelled(spark, [str(tmp_path / "r")], ["Normal", "ALL"]).count() == 2


def test_curation_is_idempotent(spark, folder):
    from evalspark.queries.curate_queries import boxes1
    once = boxes1(spark, folder)
    assert C.drop_repeats(once).count() == once.count()
