"""The n-gram join against brute force on small tables that hold near copies, chains and common n-grams."""

import itertools
import random

import pytest

from evalspark.llm.ngram_join import ngram_groups


def grams(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = {i: grams(t, k) for i, t, _ in rows}
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            comp[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_ngram_groups(make, edge_rows, k, percent):
    rng = random.Random(k)
    vocab = [f"v{i}" for i in range(40)]
    rows, i = [r for r in edge_rows if r[0] is not None], 100
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([9, 10, 12, 30, 80]))]
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, " ".join(w[:len(w) - rng.choice([0, 0, 1])]).replace("v1", "V1"), "s"))
            i += 1
    common = " ".join(vocab[:30])
    rows += [(i + j, common + " " + " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 9]))), "s") for j in range(25)]
    want = brute(rows, k, percent)
    got = ngram_groups(make(rows), words=k, percent=percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert ngram_groups(make([])).count() == 0


def test_only_sets_of_hubs_move_twice(make, monkeypatch):
    """Of a family of near copies with one hub, the hub's set alone is asked for by name."""
    from evalspark.llm import ngram_join

    base = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join(base + [f"x{i}"]), "s") for i in range(12)]
    passed, real = [], ngram_join.maybe_among

    def noted(sets, ids, key, **kw):
        out = real(sets, ids, key, **kw)
        passed.append((sets.count(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "maybe_among", noted)
    got = ngram_groups(make(rows), words=3, percent=90).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 12
    assert passed and 0 < passed[0][1] < passed[0][0] / 2
