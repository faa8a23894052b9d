"""Collocations, prefix trie and token counts against brute-force versions, with NULLs, ties, repeats and empty tables."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import pytest

sys.path.append("/opt/tokenizers")

from evalspark.llm import collocations as C  # noqa: E402
from evalspark.llm import prefix_trie as T  # noqa: E402
from evalspark.llm import token_counts as K  # noqa: E402
from evalspark.llm.queries import byte_vocabulary  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def phrases_by_hand(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for m in range(1, 6):
                f[lang or "und"].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = {}
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = {p for p in candidates for q in candidates if len(q) > len(p) and candidates[q] >= candidates[p]
                and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))}
        best = []
        for p, a in candidates.items():
            if p not in held:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], n[lang]))
        for i, (score, a, p, left, right, total) in enumerate(sorted(best)[:top]):
            out[lang, i + 1] = (p.decode(), -a, left, right, total, -score)
    return out


@pytest.mark.parametrize("every", [1, 3, 32])
def test_collocations_equal_brute_force(spark, every):
    rng = random.Random(5)
    words = ["a", "B", "the", "The", "é", "x\x1cy", " ", "it's", "w1", "w2"]
    gaps = [" ", "  ", "\t", ". ", ",", "\n", " ; ", "\x0b"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(gaps[:4] if rng.random() < .8 else gaps) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "de", None]), -1, "k", 2.5) for i in range(80)]
    rows += [(1, "new york city hall again " * 40, "en", 0, "k", 0.0)] * 3 + [(None, None, "en", 0, "k", 0.0), (7, "", "de", 0, "k", 0.0), (8, " .,", "xx", 0, "k", 0.0)]
    rows += [(9, " ".join(f"w{j % 7}" for j in range(30_000)), "fr", 0, "k", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, freq long, own string, chunk double").repartition(5)
    got = {(r["lang"], r["rank"]): tuple(r)[2:] for r in C.collocations(docs, least=6, top=40, every=every).collect()}
    assert got == phrases_by_hand([(r[2], r[1]) for r in rows], 6, 40)
    assert C.collocations(docs.limit(0)).count() == 0


def test_collocation_scores_pass_64_bits(spark):
    cases = [(10**12, 10**15, 10**12, 10**12 + 3), (999_999_999_999, 10**17, 10**13, 7 * 10**12), (100, 3, 7, 11), (7, 11, 1, 1), (10**15, 10**17, 10**15, 10**15 + 1)]
    got = spark.createDataFrame(cases, "a long, n long, l long, r long").select(C.score(*map(F.col, "anlr")).alias("s")).collect()
    assert [r["s"] for r in got] == [1000 * a * n // (x * y) for a, n, x, y in cases]


def trie_by_hand(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    members = defaultdict(list)
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c / 100) * 100
        full[c] = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def under(p):
        return [p] + [q for k in children[p] for q in under(k)]

    out = set()
    for p, m in members.items():
        sub = under(p)
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in sub),
                 sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q), hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(members)


@pytest.mark.parametrize("block", [2, 4096])
def test_prefix_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = []
    for c in [*range(0, 330, 3), 5, 7, 1000, -100, -37]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, t, None]) if rng.random() < .1 else t, rng.choice(["u", "a", None, ""]), rng.choice(["x", "y", "é", "", None])))
    rows += [rows[3], rows[3], (None, 1, "u", "lost"), (9, None, None, None), (9, 4, "u", "z" * 5000)] + [(400, i, "u", f"t{i % 3}") for i in range(3000)]
    cols = "conv_id long, turn long, role string, text string, depth long, key string"
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], cols).repartition(6)
    got = T.prefix_trie(T.branched(T.turns_of(df)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    short = [r for r in rows if r[0] != 400]
    want, n = trie_by_hand(short)
    plain = df.filter("conv_id IS NULL OR conv_id <> 400")
    have = [tuple(r) for r in T.prefix_trie(T.branched(T.turns_of(plain))).collect()]
    assert len(have) == n and set(have) == want
    assert got.agg(F.max("depth")).first()[0] >= 2990
    assert T.prefix_trie(T.turns_of(df.limit(0))).count() == 0


def test_extents_answer_every_prefix():
    import numpy as np

    rng = np.random.default_rng(2)
    lcp = np.concatenate(([-1], rng.integers(0, 4, 200)))
    at = np.repeat(np.arange(201), 4)
    depth = np.tile(np.arange(1, 5), 201)
    left, right = T.extents(T.sparse_table(lcp), at, depth)
    for i, d, a, b in zip(at, depth, left, right):
        lo, hi = i, i
        while lcp[lo] >= d:
            lo -= 1
        while hi < 200 and lcp[hi + 1] >= d:
            hi += 1
        assert (lo, hi) == (a, b)


LETTERS = ["a", "b", "s", "t", "re", "ve", "ll", "'", "'s", " ", "  ", "\n", "\t", "1", "23", "!", "...", "é", "ΣΑ", "日本", "<|endoftext|>", "x" * 30, "-" * 20,
           "the", "ing", "token", "ization", "_", "\x00", "\x1c", "\x85", "😀", "½", " "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_vocabulary())
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_transducer_and_its_chunk_maps_count_as_the_library(library):
    machine = K.Transducer(K.read_vocabulary(byte_vocabulary()))
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 25)))
        want, size = library(text), rng.randint(1, 8)
        assert machine.count(text) == want
        if "<|" not in text and text:
            maps = [machine.chunk_map(text[i:i + size]) for i in range(0, len(text), size)]
            assert machine.total(maps) == want
            prefixes = machine.scan(maps)
            assert [machine.total([m]) for m in prefixes] == [library(text[:(i + 1) * size]) for i in range(len(maps))]


def test_token_counts_of_documents(spark, make, edge_rows, library, monkeypatch):
    rng = random.Random(3)
    rows = [*edge_rows, (5, "another text of id 5", "b"), (None, None, "b"), (11, "<|endoftext|>" * 3 + " a<|endoftext|>b", "c")]
    rows += [(20 + i, "".join(rng.choice(LETTERS) for _ in range(400)), "c") for i in range(6)] + [(20, "x" * 3000, "c"), (21, " " * 2500, "c")]
    want = sorted(((i, len((t or "").encode()), library(t or ""), library(t or "") > 100) for i, t, _ in rows), key=repr)
    for chunk in (100, 1 << 16):
        got = K.count_tokens(make(rows), byte_vocabulary(), limit=100, chunk=chunk)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert K.count_tokens(make(rows).limit(0), byte_vocabulary()).count() == 0
    monkeypatch.setattr(K, "STATES", 50)  # a full table is emptied, and counts stay
    machine = K.Transducer(K.read_vocabulary(byte_vocabulary()))
    assert [machine.count(t or "") for _, t, _ in rows] == [library(t or "") for _, t, _ in rows]
