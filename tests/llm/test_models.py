"""Nearest neighbours against brute force, language ID against held-out labels."""

import zlib

import numpy as np
import pytest

from evalspark.llm import neighbours
from evalspark.llm.language import WINDOW, Network, Reader, held_out, identify, train


def brute(rows, step, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = set()
    for q in {i for i, _ in ok if i % step == 0}:
        x = min(v.tolist() for i, v in ok if i == q)
        near = sorted((-(np.array(x) * v).sum(), i) for i, v in ok if i != q and len(v) == len(x))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("tile,block", [(2048, 4096), (7, 3)])
def test_neighbours(spark, monkeypatch, tile, block):
    monkeypatch.setattr(neighbours, "TILE_ROWS", tile)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # one common vector: ties
    rows += [(300, None), (302, []), (304, [0.0] * 6), (306, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (308, [float("nan")] * 6), (310, [float("inf")] * 6),
             (None, rows[3][1]), (400, [1.0, 2.0]), (401, [3.0, 1.0]), (30, rows[5][1]), (31, rows[6][1]), (31, rows[6][1])]
    df = spark.createDataFrame([(i, v, 1, 0.5, 7) for i, v in rows], "vec_id long, embedding array<float>, id int, score double, rank int").repartition(3)
    got = neighbours.nearest(df, query_step=10, k=5).collect()
    want = brute(rows, 10, 5)
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {w[:3] for w in want} and len(got) == sum(1 for r in got)
    exact = {w[:3]: w[3] for w in want}
    assert all(r.score == pytest.approx(exact[r.query_id, r["rank"], r.vec_id], rel=1e-12, abs=1e-12) for r in got)
    assert neighbours.nearest(df.filter("false")).count() == 0


def test_neighbours_of_a_query_with_many_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(1, 150) if i % 10]
    rows += [(500, [9.0, -8.0, 7.0, -6.0, 5.0, 4.0])] * 5 + [(510, [3.0] * 6)] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = neighbours.nearest(df, query_step=10, k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(w[:3] for w in brute(rows, 10, 5))


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 33)) * 10.0 ** rng.integers(-3, 3, (200, 1)), rng.normal(size=(300, 33))
    (a, sa, na, ea), (b, sb, nb, eb) = neighbours.quantise(x), neighbours.quantise(y)
    about = (a.astype(float) @ b.T.astype(float)) * sa[:, None] * sb
    assert (abs(x @ y.T - about) <= ea[:, None] * nb + (na + ea)[:, None] * eb + 1e-9).all()


def test_tables_equal_the_network_and_gradients_are_right():
    rng = np.random.default_rng(2)
    net = Network.new(["a", "b", "c"], rng)
    x = rng.integers(0, 256, (5, WINDOW)).astype(np.uint8)
    y = np.array([0, 1, 2, 0, 1])
    loss = lambda: -np.log(Reader(net).chances(x)[np.arange(5), y]).mean()
    for p, g in zip(net.parts(), net.step(x, y)):
        at = np.unravel_index(abs(g).argmax(), g.shape)
        keep, p[at] = p[at], p[at] + 1e-2
        up = loss()
        p[at] = keep - 1e-2
        down = loss()
        p[at] = keep
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.1)


def test_language(spark, folder, make, edge_rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    net = train(docs)
    rows = identify(docs, net).withColumn("held", held_out()).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    hidden = docs.selectExpr("doc_id", "text", "'zz' AS lang", "'q' AS source", "n_chars")
    assert {(r.doc_id, r.lang_pred) for r in identify(hidden, net).collect()} == {(r.doc_id, r.lang_pred) for r in rows}
    edge = identify(make(edge_rows), net)
    assert edge.count() == len(edge_rows)
    said = {(r.doc_id, r.text): r.lang_pred for r in edge.collect()}
    assert all(said[i, t] == "und" for i, t in [(1, None), (2, ""), (3, " \n\t"), (9, "\n\n")]) and said[4, "alpha beta"] in net.names
    assert train(make([])) is None and {r.lang_pred for r in identify(make(edge_rows), None).collect()} == {"und"}
