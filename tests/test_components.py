"""Connected components over several rounds."""

from __future__ import annotations

import random

import pytest

from evalspark.plans.components import connected_components


def test_rounds_do_not_multiply_guessed_sizes(spark):
    """Sizes guessed in a round must not carry into the next: their digits grew ninefold a round, in every plan."""
    order = list(range(60))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a bigint, b bigint")
    got = connected_components(spark.range(61).withColumnRenamed("id", "node"), edges)
    guess = str(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert len(guess) < 100
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(60)} | {(60, 60)}


@pytest.mark.parametrize("seed", [1, 2])
def test_sketches_never_rule_out_a_link(seed):
    from evalspark.llm.ngram_join import sketch
    import numpy as np

    rng = np.random.default_rng(seed)
    for n, own in ((1, 0), (30, 3), (300, 40), (3000, 2000)):
        both, a, b = (rng.integers(0, 2**64, k, np.uint64) for k in (n, own, own))
        x, y = np.concatenate([both, a]), np.concatenate([both, b])
        apart = int(np.unpackbits((sketch(x) ^ sketch(y)).view(np.uint8)).sum())
        assert n <= (len(x) + len(y) - apart) // 2
    assert not sketch(np.empty(0, np.uint64)).any()


def test_repeated_rows_do_not_count_an_overlap_twice(spark):
    """Two texts share 85 of 100 n-grams; at 90 % they do not link, however often one of them was delivered."""
    from evalspark.llm.ngram_join import ngram_groups

    words = [f"w{i}" for i in range(200)]
    a, b = " ".join(words[:100]), " ".join(words[8:108])
    rows = [(1, a), (1, a), (2, b), (2, b), (3, a + " end")]
    got = ngram_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), words=3, percent=90).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 2), (2, 2), (3, 1)]
