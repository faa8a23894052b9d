"""The stages on the smallest tables, each against what its input asks for."""

import itertools
import random
from collections import Counter

from corpus_pipeline import STAGES
from evalspark.llm.mixing import mix


def grams(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {"": {r.doc_id: r.text for r in docs.collect()}}
    for name, stage in STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert len(kept["language"]) > 0.95 * len(kept[""]) and set(kept["lines"]) <= set(kept["language"])
    seen = set()
    for i in sorted(kept["language"]):
        own = kept["language"][i].split("\n")
        fresh = [t for t in own if not t.strip(" ") or (t not in seen and not seen.add(t))]
        assert set((kept["lines"].get(i) or "").split("\n")) <= set(fresh) | {""}
    sets = {i: grams(t) for i, t in kept["lines"].items()}
    linked = {b for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert set(kept["near_duplicates"]) == set(sets) - linked


def test_rows_without_ids_and_repeated_ids(make, spark, folder):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    a, b, c, d = text(60), text(60), text(60), text(60)
    rows = [(None, a, "s"), (None, text(40), None), (None, b, "s"), (7, b + " more", "s"), (3, c, "t"), (3, c, "t"), (4, d, "t"), (4, text(50), "t"),
            (9, d, "s"), (-5, a + " x", None), (None, text(30), "t"), (None, c, "s")]
    stages = dict(STAGES)
    lines = stages["lines"](spark, make(rows), folder).collect()
    assert {(r.doc_id, r.source) for r in lines} >= {(None, None), (None, "t"), (-5, None)}
    got = stages["near_duplicates"](spark, make(rows), folder)
    clean = [rows[k] for k in (1, 3, 4, 6, 7, 9, 10)]
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == Counter(clean)
    many = clean + [(None, text(5), "s") for _ in range(40)] + [(8, text(6), "t") for _ in range(20)]
    taken = stages["mixed"](spark, make(many), folder)
    times = Counter((r.doc_id, r.text, r.source) for r in taken.collect())
    wanted = {r.source: int(r.target / r.source_size + 1e-12) for r in mix(make(many)).collect()}
    assert all(times[r] - wanted[r[2]] in (0, 1) for r in many) and set(times) <= set(many)
    assert any(i is None for i, _, _ in times)
    codes = stages["encoded"](spark, taken, folder).collect()
    assert Counter(r.doc_id for r in codes) == Counter(i for (i, _, _), n in times.items() for _ in range(n))
