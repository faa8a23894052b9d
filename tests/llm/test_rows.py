"""Exact dedup, mixing and BPE against brute force."""

import collections
import hashlib
import random
import re

import pytest
from tokenizers import Tokenizer

from evalspark.llm.bpe import Bpe, encode_documents
from evalspark.llm.exact_dedup import exact_dedup
from evalspark.llm.mixing import mix, source_targets
from evalspark.llm.queries import word_vocabulary


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(make, edge_rows, keep):
    got = exact_dedup(make(edge_rows), keep=keep).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in edge_rows:
        groups[t or ""].append(i)
    pick = max if keep == "largest" else min
    want = []
    for t, ids in groups.items():
        best = pick([i for i in ids if i is not None], default=None)
        want += [(i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert exact_dedup(make([])).count() == 0


def shares(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixing(make, edge_rows):
    rng = random.Random(5)
    rows = edge_rows + [(100 + i, "w " * rng.randint(1, 90), rng.choice(["a", "b", "c", None] + ["hot"] * 3)) for i in range(2500)]
    got = mix(make(rows)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = shares(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        assert r.copies in (int(r.target / max(1, r.source_size) + 1e-12), int(r.target / max(1, r.source_size) + 1e-12) + 1)
        taken[r.source] += r.taken
    biggest = {s: max(r.size for r in got if r.source == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= biggest[s] + 1e-6 for s in sizes)
    again = mix(make(rows, 7)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert mix(make([])).count() == 0


def test_targets_by_repeated_resharing(spark):
    rng = random.Random(1)
    for _ in range(4):
        sizes = {f"s{k:02d}": rng.choice([0, 1, 10, 500, 9000]) + 1 for k in range(rng.randint(1, 12))}
        df = spark.createDataFrame([("=" + s, n, 1, 1) for s, n in sizes.items()], "skey string, source_size long, n long, n_rows long")
        got = {r.skey[1:]: r.target for r in source_targets(df).collect()}
        assert got == pytest.approx(shares(sizes), rel=1e-12)


def test_bpe_equals_the_library(spark, folder, make, edge_rows):
    coder, lib = Bpe(open(word_vocabulary(), encoding="utf-8").read()), Tokenizer.from_file(word_vocabulary())
    lib.no_truncation()
    lib.no_padding()
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    texts += [t or "" for _, t, _ in edge_rows]
    texts += ["\x1c a\x85b c   d", "'S 'll'd 'street don't", "a<|startoftext|>b<|endoftext|><|x", "İΣΑΣ ﬃ ǅ é 日本語 한글 👩‍👩 ½ ٣", "x" * 5000, "a" + "́" * 40]
    rng = random.Random(3)
    texts += ["".join(rng.choice("abc é'<|>\n\t12Σß") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == ids, t
        assert coder.encoded(t) == (" ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False), len(ids))
    got = {(r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in encode_documents(make(edge_rows), word_vocabulary()).collect()}
    want = set()
    for i, t, _ in edge_rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), tuple(ids), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert encode_documents(make([]), word_vocabulary()).count() == 0
