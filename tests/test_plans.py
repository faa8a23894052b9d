"""Plans of this library against brute force: weight vectors, state tables, stateful streams, versions, blocks, text prints."""

import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.functions.simhash import text_fingerprints
from evalspark.operators import curate as C
from evalspark.operators import dedup as D
from evalspark.operators import infer as B
from evalspark.operators import thresholds as T
from evalspark.plans import vectors as V
from evalspark.plans.fits import logistic
from evalspark.plans.groups import block_join
from evalspark.sources import io as S
from evalspark.sources import versions
from evalspark.streaming import stream as W


def draws_by_hand(n, strata, n_boot):
    """Weights of the units 0..n-1 of a stratum: slot i of draw d picks a unit by the md5 of its key."""
    w = np.zeros((n, n_boot), int)
    for i in range(n):
        for d in range(n_boot):
            h = int(hashlib.md5(":".join([*strata, str(d), str(i), "0"]).encode()).hexdigest()[:13], 16)
            w[min(int(h / 2**52 * n), n - 1), d] += 1
    return w


def auc(y, p, w):
    pos, neg = y == 1, y == 0
    less = (p[pos][:, None] > p[neg][None, :]) + 0.5 * (p[pos][:, None] == p[neg][None, :])
    return (w[pos][:, None] * w[neg][None, :] * less).sum() / (w[pos].sum() * w[neg].sum())


@pytest.mark.parametrize("group_rows", [10, 2_000_000])
def test_vectors_are_the_draws_and_their_metrics(spark, monkeypatch, group_rows):
    monkeypatch.setattr(V, "CELLS", 4000)
    monkeypatch.setattr(V, "PICKS", 50)
    monkeypatch.setattr(V, "BLOCK", 4)
    rng = np.random.default_rng(1)
    n, boot = 90, 6
    y, unit, p = rng.integers(0, 2, n), rng.integers(0, 13, n), np.round(rng.random(n), 2)
    unit[y == 1] += 20
    unit[:40] = np.where(y[:40] == 1, 20, 0)  # a hot unit in each class
    rows = [("c", "a", 0, i, f"u{u:02d}", int(k), float(x)) for i, (u, k, x) in enumerate(zip(unit, y, p))]
    P = spark.createDataFrame(rows, "cohort string, arm string, seed int, item_id int, unit string, y int, p double").repartition(5)
    names = {k: sorted({f"u{u:02d}" for u in unit[y == k]}) for k in (0, 1)}
    w = np.zeros((n, boot), int)
    for k in (0, 1):
        drawn = draws_by_hand(len(names[k]), ["c", str(k)], boot)
        for i in np.flatnonzero(y == k):
            w[i] = drawn[names[k].index(f"u{unit[i]:02d}")]
    got = {(r["y"], r["unit"], r["draw"]): r["weight"] for r in B.draw_units(B.units(P), boot).collect()}
    assert got == {(k, u, d): v for k in (0, 1) for j, u in enumerate(names[k]) for d, v in enumerate(draws_by_hand(len(names[k]), ["c", str(k)], boot)[j]) if v}
    weights = B.make_weights(P, boot)
    t = {r["draw"]: r for r in V.vector_metrics(P, weights.vectors, boot, ["cohort", "arm", "seed"], ["cohort", "y"], "unit", group_rows=group_rows).collect()}
    assert sorted(t) == list(range(-1, boot))
    for d, r in t.items():
        each = np.ones(n) if d < 0 else w[:, d]
        if each[y == 1].sum() and each[y == 0].sum():
            assert abs(1 - r["lost"] / (2 * r["n_pos"] * r["n_neg"]) - auc(y, p, each)) < 1e-12
        tp = {s: each[(y == 1) & (p >= s)].sum() for s in set(p)}
        fp = {s: each[(y == 0) & (p >= s)].sum() for s in set(p)}
        ap = sum(each[(y == 1) & (p == s)].sum() * tp[s] / max(tp[s] + fp[s], 1) for s in set(p))
        assert abs(r["ap"] - ap) < 1e-9 and r["tp"] == each[(y == 1) & (p >= .5)].sum() and r["fp"] == each[(y == 0) & (p >= .5)].sum()
    bad = B.weighted_metrics(P.unionByName(P.limit(1).withColumn("p", F.lit(None).cast("double"))), weights, ["cohort", "arm", "seed"])
    assert bad.filter("draw = -1 AND value IS NOT NULL").count() == 0


def test_ten_thousand_fits_in_one_run(spark):
    g = spark.range(80_000).select((F.col("id") % 10_000).alias("g"), F.floor(F.col("id") / 10_000).alias("i"))
    x = (F.col("i") - 3.5) / 2
    df = g.select("g", x.alias("x"), ((F.col("i") * 7 + F.col("g")) % 3 == 0).cast("int").alias("y"), (F.col("i") % 2).cast("int").alias("fold"))
    beta = {r["g"]: np.array(r["beta"]) for r in logistic(df, ["g"], ["x"]).collect()}
    assert len(beta) == 10_000
    rows = df.filter("g < 3").collect()
    both = {(r["g"], r["model"]): np.array(r["beta"]) for r in logistic(df.filter("g < 3"), ["g"], ["x"], fold="fold", folds=2).collect()}
    for k in range(3):
        for m in (None, 0, 1):
            part = [r for r in rows if r["g"] == k and r["fold"] != m]
            X, y = np.array([[1.0, r["x"]] for r in part]), np.array([r["y"] for r in part])
            b = beta[k] if m is None else both[k, m]
            grad = X.T @ (1 / (1 + np.exp(-X @ b)) - y) + np.array([0.0, b[1]])
            assert np.abs(grad).max() < 1e-6
    P = g.select("g", (0.05 + 0.9 * ((F.col("i") * 37 + F.col("g")) % 101) / 101.0).alias("p"), (F.col("i") % 2).cast("int").alias("y"))
    prior = T.prior_shift(P, ["g"], iters=8)
    assert prior.count() == 10_000 and prior.filter("prior <= 0 OR prior >= 1").count() == 0
    one = np.array([r["p"] for r in P.filter("g = 5").collect()])
    pi = 0.5
    for _ in range(8):
        q = (one * pi / .5 / (one * pi / .5 + (1 - one) * (1 - pi) / .5)).mean()
        if abs(q - pi) < 1e-6:
            break
        pi = q
    assert abs(prior.filter("g = 5").first()["prior"] - pi) < 1e-9
    assert T.fit_temperature(P.filter("g < 50"), ["g"]).count() == 50


def test_best_flags_wait_for_their_turn_and_a_silent_run_ends(spark):
    day = 86_400
    waves = [[("a", 2, 2 * day, .5, .1), ("a", 1, day, .6, .2), ("b", 1, day, None, .1), ("b", 4, 4 * day, .9, .1)],
             [("a", 4, 4 * day, .7, .1), ("b", 2, 2 * day, .2, .5), ("b", 2, 2 * day, .2, .4)],
             [("a", 3, 3 * day, .6, .1)], [("tick", 1, 90 * day, .1, .1)], [("b", 1, 91 * day, .05, .3)]]
    rows = [(i, *r) for i, wave in enumerate(waves) for r in wave]
    tagged = spark.createDataFrame(rows, "wave int, run_id string, epoch bigint, at bigint, metric double, loss double").select(
        "wave", "run_id", "epoch", F.timestamp_seconds("at").alias("ts"), "metric", "loss")
    out = W.replay(spark, tagged, [f"wave = {i}" for i in range(len(waves))], lambda s: W.stream_best(s, "10 days"))
    got = sorted((r["run_id"], r["epoch"], r["metric"] or 0.0, r["best"]) for r in spark.read.parquet(out).collect())
    assert got == sorted([("a", 1, .6, 1), ("a", 2, .5, 0), ("a", 3, .6, 1), ("a", 4, .7, 1), ("b", 1, 0.0, 0), ("b", 2, .2, 1), ("b", 2, .2, 1), ("b", 4, .9, 1),
                          ("tick", 1, .1, 1), ("b", 1, .05, 1)])


def test_latest_rows_merge_and_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "latest")
    write = W.latest_sink(path, compact=3)
    batches = [spark.createDataFrame([("r", e, 10 * b + e, float(b)) for e in range(b % 3, 5)], "run_id string, epoch bigint, arrival bigint, metric double") for b in range(8)]
    for i, b in enumerate(batches):
        write(b, i)
        write(b, i)
        kept = json.loads((tmp_path / "latest" / "_current").read_text())
        assert len(kept["batches"]) < 3 and kept["last"] == i
    write(batches[2], 2)
    got = {r["epoch"]: r["arrival"] for r in W.read_latest(spark, path).collect()}
    assert got == {e: max(10 * b + e for b in range(8) if e >= b % 3) for e in range(5)}
    assert len(list((tmp_path / "latest").glob("batch-*"))) <= 2 * 3


def test_a_published_result_is_whole(spark, tmp_path):
    path = str(tmp_path / "result")
    with pytest.raises(FileNotFoundError):
        versions.read_published(spark, path)
    versions.publish(spark.range(3), path)
    before = versions.read_published(spark, path)
    with pytest.raises(Exception, match="broken"):
        versions.publish(spark.range(5).withColumn("id", F.when(F.col("id") > 3, F.raise_error(F.lit("broken"))).otherwise(F.col("id"))), path)
    assert versions.read_published(spark, path).count() == 3
    versions.publish(spark.range(4).withColumn("x", F.lit(1)), path, ["id"])
    assert versions.read_published(spark, path).columns == ["id"] and versions.read_published(spark, path).count() == 4 and before.count() == 3
    versions.publish(spark.range(5), path)
    assert len(list((tmp_path / "result").glob("v-*"))) == 2


def test_wanted_runs_open_only_their_files(spark, tmp_path):
    for arm, seed, cohort in [("a", 0, "val"), ("a_b", 0, "val"), ("a", 1, "test_far"), ("b", 0, "val")]:
        (tmp_path / f"cls_{arm}_seed{seed}_{cohort}.json").write_text(json.dumps({"y_true": [1], "probs": [[.1, .9]], "names": ["i"]}))
    d = S.read_predictions(spark, str(tmp_path), cohorts=["val"], arms=["a"])
    assert [f.rsplit("/", 1)[1] for f in d.inputFiles()] == ["cls_a_seed0_val.json"] and d.count() == 1
    d = S.read_predictions(spark, str(tmp_path), cohorts=["far"])
    assert len(d.inputFiles()) == 1 and d.first()["cohort"] == "far"
    assert S.read_predictions(spark, str(tmp_path), arms=["none"]).count() == 0 and S.read_predictions(spark, str(tmp_path)).count() == 4


def test_block_join_of_crowded_keys(spark):
    a = spark.range(700).select((F.col("id") % 7 % 3).alias("k"), F.col("id").alias("a"))
    b = spark.range(300).select((F.col("id") % 5 % 4).alias("k"), F.col("id").alias("b"))
    want = a.join(b, "k")
    got = block_join(a, b, ["k"], limit=16)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_opposite_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(f"f{i % 3}", i, int(rng.integers(0, 2)), *[float(v) for v in (rng.integers(-20, 300), rng.integers(-20, 300), rng.integers(1, 90), rng.integers(1, 90))],
             ["lymph", "blast", "mono"][rng.integers(0, 3)], *[float(v) for v in (rng.integers(0, 300), rng.integers(0, 300), *rng.choice([1, 4, 30, 500], 2))]) for i in range(250)]
    df = spark.createDataFrame(rows, "file_name string, annotation_id int, label int, x0 double, y0 double, win_w double, win_h double, category string, "
                                     "x double, y double, w double, h double")
    opposing = {0: ["blast", "mono"], 1: ["lymph"]}
    got = {r["annotation_id"]: r["opposite"] for r in C.opposite_neighbour(df, df, opposing).collect()}
    for f, i, lab, x0, y0, ww, wh, *_ in rows:
        hit = any(g == f and j != i and cat in opposing[lab]
                  and max(0, min(x0 + ww, x + w) - max(x0, x)) * max(0, min(y0 + wh, y + h) - max(y0, y)) >= .25 * w * h
                  for g, j, _, _, _, _, _, cat, x, y, w, h in rows)
        assert got[i] == hit


def test_pairs_with_one_code_in_every_item(spark):
    rng = np.random.default_rng(9)
    rows = [("c", i, 0) for i in range(150)] + [("c", i, int(k)) for i in range(150) for k in rng.integers(1, 12, 6)]
    codes = spark.createDataFrame(rows, "cls string, item_id int, code int").distinct()
    feats, _ = D.feature_sets(codes)
    sets = {}
    for r in feats.collect():
        sets.setdefault(r["content"], set()).add(r["code"])
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 3 and len(sets[a] & sets[b]) >= .8 * max(len(sets[a]), len(sets[b]))}
    have = {(r["a"], r["b"]) for r in D.pair_evidence(feats, D.pairs_within(feats, 3, .8)).filter("matches >= 3 AND overlap >= 0.8").collect()}
    assert have == want and want


def simhash(grams):
    if not grams:
        return 0
    hs = [int(hashlib.md5(g.encode()).hexdigest()[:16], 16) for g in grams]
    v = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return v - (1 << 64) if v >> 63 else v


def test_text_fingerprints_equal_brute_force(spark, monkeypatch):
    from evalspark.functions import simhash as S

    monkeypatch.setattr(S, "BLOCK", 7)
    texts = [None, "", " \n", "One two", "The quick  brown fox!\njumps over\tthe lazy dog.", "b line\na line\nC line, with: signs", "é😀 ΑΒ " * 9]
    rows = [("s", i, t) for i, t in enumerate(texts)] + [("s", 4, texts[4]), ("s", 3, "another text of item 3"), (None, None, "no key")]
    df = spark.createDataFrame(rows, "source string, item_id int, text string")
    got = {(r["source"], r["item_id"], tuple(r["h1"]), tuple(r["h2"])) for r in text_fingerprints(df, ["source", "item_id"]).collect()}
    want = set()
    for s, i, t in rows:
        t = t or ""
        v = [t, t.lower()]
        v.append("\n".join(sorted(v[1].split("\n"), key=str.encode)))
        v.append(re.sub("[ \t\r\n]+", " ", v[2]).strip(" "))
        v.append(re.sub(" +", " ", "".join(c for c in v[3] if c.isalpha() or c.isnumeric() or c == " ")).strip(" "))
        pairs = []
        for x in v:
            words = [w for w in re.split("[ \t\r\n]+", x) if w]
            shingles = [" ".join(words[k:k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
            grams = [x[k:k + 5] for k in range(max(len(x) - 4, 1))] if x else []
            pairs.append((simhash(shingles), simhash(grams)))
        want.add((s, i, tuple(p[0] for p in pairs), tuple(p[1] for p in pairs)))
    assert got == want


def test_text_fingerprints_move_no_grams(spark, capsys):
    """A table in one file is spread before the work, and no row per gram is made."""
    df = spark.createDataFrame([("s", i, "the quick brown fox") for i in range(50)], "source string, item_id int, text string").coalesce(1)
    t = text_fingerprints(df, ["source", "item_id"])
    t.explain()
    plan = capsys.readouterr().out
    assert "Generate" not in plan and "RoundRobinPartitioning" in plan
    assert t.count() == 50 and t.select("h1", "h2").distinct().count() == 1


def test_votes_of_long_and_varied_texts(monkeypatch):
    """Stretches that cut a text, and alphabets too large for one long, give the votes of the whole text."""
    from evalspark.functions import simhash as S

    monkeypatch.setattr(S, "STRETCH", 64)
    han = "".join(chr(0x4E00 + i) for i in range(9000)) + "".join(chr(0x1F600 + i % 60) for i in range(200))
    texts = ["ab " * 300, han[:300], "", "abcd", " \t", "one two"] + ["some words, repeated " * 20] * 2
    for stretch, more in ((64, []), (1 << 20, [han])):
        monkeypatch.setattr(S, "STRETCH", stretch)
        chars, words = S.char_votes(texts + more), S.word_votes(texts + more)
        for i, t in enumerate(texts + more):
            w = [x for x in re.split("[ \t\r\n]+", t) if x]
            runs = [[t[k:k + 5] for k in range(max(len(t) - 4, 1))] if t else [], [" ".join(w[k:k + 3]) for k in range(max(len(w) - 2, 1))] if w else []]
            for (votes, n), grams in zip((chars, words), runs):
                assert n[i] == len(grams) and S.majority(votes[i:i + 1], n[i:i + 1])[0] == simhash(grams)


def test_md5_heads():
    from evalspark.functions.digests import md5_heads

    messages = [bytes(range(n)) for n in (0, 1, 5, 54, 55, 56, 57, 64, 130)] * 1000 + [b"x"]
    got = md5_heads(b"".join(messages), [len(m) for m in messages])
    assert got.tolist() == [int(hashlib.md5(m).hexdigest()[:16], 16) for m in messages]


def test_text_fingerprints_of_long_texts_delivered_often(spark):
    """Rows that agree in key and text have the fingerprint of one, however many votes they would sum to."""
    text = " ".join(f"w{k % 313}" for k in range(6000))
    df = spark.createDataFrame([("s", 1, text)] * 6, "source string, item_id int, text string")
    many, one = (text_fingerprints(d, ["source", "item_id"]).collect() for d in (df, df.limit(1)))
    assert many == one and len(one) == 1
