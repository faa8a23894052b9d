"""Repeat removal, line dedup, HTML text and secrets against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import pytest

from evalspark.llm import repeats, secrets
from evalspark.llm.html_text import extract, main_text, minimum_cut
from evalspark.llm.line_dedup import line_dedup


def test_suffix_sort_finds_equal_windows():
    rng = random.Random(1)
    base = bytes(rng.choice(b"ab") for _ in range(300))
    contexts = [base[rng.randrange(120):][:rng.randint(64, 160)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(40)]
    contexts += [b"a" * 100, b"\x00" * 70, base[:64], base[:64]]
    groups = [rng.randrange(3) for _ in contexts]
    got = repeats.repeated_windows(contexts, groups, 64)
    seen = Counter((g, c[i:i + 64]) for g, c in zip(groups, contexts) for i in range(len(c) - 63))
    for g, c, flags in zip(groups, contexts, got):
        assert flags.tolist() == [seen[g, c[i:i + 64]] > 1 for i in range(len(c) - 63)]


@pytest.mark.parametrize("hot", [512, 1])
def test_repeats(make, edge_rows, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(repeats, "PIECE", 100)
    rng = random.Random(hot)
    word = lambda n: " ".join(rng.choice(["é", "ab", "cde", "fg"]) + str(rng.randrange(50)) for _ in range(n))
    common, rows = word(20), [(1, None, "s"), (2, "", "s"), (3, "z" * 300, "s"), (4, word(60), "s"), (6, edge_rows[6][1][:3000], "s")]
    rows += [(10 + i, word(rng.randint(0, 9)) + " " + common[rng.randint(0, 9):] + word(rng.randint(0, 9)), "s") for i in range(25)]
    rows += [(50, rows[4][1], "s"), (51, rows[3][1], "s")]
    seen = Counter()
    for _, t, _ in rows:
        b = (t or "").encode()
        seen.update(b[i:i + 64] for i in range(len(b) - 63))
    want = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - 63):
            if seen[b[s:s + 64]] > 1:
                gone[s:s + 64] = [True] * 64
        spans = sum(1 for k, _ in itertools.groupby(gone) if k)
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = repeats.remove_repeats(make(rows), span=64).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(rows)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_by_id_and_text(make, edge_rows):
    rng = random.Random(3)
    word = lambda n: " ".join(rng.choice(["é", "ab", "cde", "fg"]) + str(rng.randrange(50)) for _ in range(n))
    passage, other, alone = word(40), word(40), word(60)
    rows = edge_rows + [(None, word(5) + passage, "s"), (20, passage + word(9), "s"), (21, alone, "s"), (21, alone, "s"), (22, "é" + other, "s"),
                        (22, word(200) + other, "s"), (None, alone[:150] + "!" + word(9), "s"), (None, word(50), "s"), (23, word(4), "s")]
    rows += rows[-2:-1]
    texts = {(i, t or "") for i, t, _ in rows}
    seen = Counter(b[i:i + 64] for _, t in texts for b in [t.encode()] for i in range(len(b) - 63))
    want = Counter()
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 63):
            if seen[b[s:s + 64]] > 1:
                gone[s:s + 64] = b"\1" * 64
        want[i, len(b), sum(gone), sum(1 for k, _ in itertools.groupby(gone) if k), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    got = repeats.remove_repeats(make(rows), span=64).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_line_dedup(make):
    rng = random.Random(8)
    bases = ["".join(rng.choice("abé ") for _ in range(n)) + "x" for n in (5, 16, 17, 40, 63, 64, 65, 127, 128, 129, 200)]
    def edit(t):
        k = rng.randrange(len(t))
        return rng.choice([t, t, t[:k] + t[k + 1:], t[:k] + "q" + t[k:], t[:k] + "z" + t[k + 1:]])
    rows = [(1, None, "s"), (2, "", "s"), (3, "\n\n", "s"), (4, "same\nsame\n\nsame", "s")]
    rows += [(10 + i, "\n".join(edit(edit(rng.choice(bases))) for _ in range(rng.randint(1, 4))), "s") for i in range(60)]
    lines = [(i, k, t) for i, text, _ in rows for k, t in enumerate((text or "").split("\n"))]
    first = {}
    for i, k, t in lines:
        first.setdefault(t, (i, k))
    near = {t for t in first if len(t) >= 16 and any(len(u) >= 16 and first[u] < first[t] and abs(len(t) - len(u)) < 2 and distance(t, u) == 1 for u in first)}
    want = {}
    for i, text, _ in rows:
        parts = (text or "").split("\n")
        kept = [t for k, t in enumerate(parts) if not t.strip(" ") or (first[t] == (i, k) and t not in near)]
        want[i] = (0, 0, None) if text is None else (len(parts), len(parts) - len(kept), "\n".join(kept))
    got = line_dedup(make(rows), carry=("source", "size")).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == want and len(got) == len(rows)
    assert {(r.source, r["size"]) for r in got} == {("s", -1)}


def test_minimum_cut():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 7)
        keep, drop = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(1, 6)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda side: sum(d if s else k for s, k, d in zip(side, keep, drop)) + sum(w for a, b, w in edges if side[a] != side[b])
        assert cost(minimum_cut(keep, drop, edges)) == min(map(cost, itertools.product([True, False], repeat=n)))


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=x>One</a><li>Two</ul></nav>
<div class="cookie-notice">We use cookies. Please accept them all, dear reader of this page.</div><article><h1>A  headline&amp;</h1><p>First   para <b>with</b> words.<p>Second
para, caf&eacute; &#8212; done.<br></article><section id="comments"><p>I disagree with all of this, said a reader.</p></section><form><p>Sign up now.</p></form><footer>(c)</footer>"""


def test_html(spark):
    assert main_text(PAGE) == "A headline&\nFirst para with words.\nSecond para, café — done."
    assert [main_text(x) for x in (None, "", "<", "<p", "<script>x", "<!-- x")] == [""] * 6
    long = "<article>" + "<p>A sentence of the article that goes on.</p>" * 3000 + "</article>"
    rows = [(1, "u", PAGE, 1, "t"), (2, None, None, 1, "t"), (None, "u", "", 1, "t"), (1, "u", PAGE, 1, "t"), (3, "u", long, 1, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = extract(df).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and sum(r.text == "" for r in got) == 2
    assert extract(df.filter("false")).count() == 0


def test_html_keeps_text_after_capital_dotted_i_and_in_formulas():
    page = "<article><p>" + "İ" * 40 + " ilk.<script>var a = 1;</SCRIPT><p>İkinci paragraf burada.<style>p{}</style><p>Son paragraf da burada.</article>"
    assert main_text(page) == "İ" * 40 + " ilk.\nİkinci paragraf burada.\nSon paragraf da burada."
    page = ("<article><p>The sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> and <svg><title>t</title><text>label</text></svg> are shown here.</p>"
            "<noscript><p>This paragraph stands in for the script.</p></noscript><video>No video, but this sentence.</video></article>")
    assert main_text(page) == ("The sum x+y and label are shown here.\nThis paragraph stands in for the script.\nNo video, but this sentence.")


def test_secrets(spark, make, edge_rows):
    model = secrets.train(secrets.labelled_findings(spark, 900), trees=10)
    key, digest = hashlib.sha1(b"k").hexdigest(), hashlib.sha1(b"d").hexdigest()
    rows = edge_rows + [(20, f'some words token = "{key}" more', "s"), (21, f"see commit {digest} there", "s"), (22, "card 4716920148831207 and mail8.example.com/index2", "s"),
                        (23, f"a token={key}, and token={key[::-1]}", "s")]
    got = secrets.scan(make(rows), model).collect()
    said = {(r.doc_id, r.token): r.is_secret for r in got}
    assert said[20, key] and not said[21, digest] and said[23, key[::-1]]
    assert not any(v for (i, _), v in said.items() if i == 22) and (22, "4716920148831207") in said
    test = secrets.scan(make([]), model)
    assert test.count() == 0
    held = secrets.labelled_findings(spark, 3000).exceptAll(secrets.labelled_findings(spark, 900))
    from pyspark.ml.feature import VectorAssembler
    judged = model.transform(VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(secrets.features(held)))
    assert judged.filter("prediction = label").count() / judged.count() > 0.95
