"""BPE encoding with a queue of merge ranks over a linked symbol list, and decoding by vocabulary strings."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from evalspark.llm.common import plain

CACHE_WORDS = 200_000
VOCABULARY_BYTES = 64 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: Latin-1's visible characters stand for themselves, the others
    take code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Bpe:
    """Encoder and decoder for a vocabulary file with word ends (lower case, white space dropped)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {self.ids[a] << 20 | self.ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        self.letters = byte_letters()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.known: dict[str, tuple[str, str, int]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word. Symbols form a doubly linked list; a queue holds rank << 32 | position of neighbours that
        merge. A rank names one pair, so an entry is stale, and skipped, unless its pair still stands at its position."""
        letters = [self.letters[b] for b in word.encode("utf-8")]
        letters[-1] += self.end
        symbol = [self.ids[x] for x in letters]
        n, rank = len(symbol), self.rank.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [r << 32 | i for i in range(n - 1) if (r := rank(symbol[i] << 20 | symbol[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if j < 0 or symbol[i] < 0 or rank(symbol[i] << 20 | symbol[j]) != r:
                continue
            new = self.made[r]
            symbol[i], symbol[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(new << 20 | symbol[k])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank(symbol[h] << 20 | new)) is not None:
                heapq.heappush(queue, r << 32 | h)
        return [s for s in symbol if s >= 0]

    @staticmethod
    def normalise(text: str) -> str:
        """NFC, then lower case letter by letter: a capital sigma is not given its word-final form."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def words(self, text: str) -> list[str]:
        """Pieces to encode; a special string that stands in the raw text is one piece."""
        if not self.marks or "<|" not in text and not self.marks.search(text):
            return self.pieces.findall(self.normalise(text))
        out: list[str] = []
        for part in self.marks.split(text):
            out += [part] if part in self.special else self.pieces.findall(self.normalise(part))
        return out

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in ([self.special[w]] if w in self.special else self.merge(w))]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings in order; the file names no decoder, so a space stands between them."""
        return " ".join(self.strings[i] for i in ids)

    def encoded(self, text: str) -> tuple[str, str, int]:
        """Decimal ids with spaces, decoded text, number of ids. Words met before are looked up; CACHE_WORDS of them are
        kept, which are the frequent ones, as those are met first."""
        words = self.words(text)
        found = list(map(self.known.get, words))
        if None in found:
            new = {w: None for w, f in zip(words, found) if f is None}
            for w in new:
                ids = [self.special[w]] if w in self.special else self.merge(w)
                new[w] = (" ".join(map(str, ids)), self.decode(ids), len(ids))
            if len(self.known) < CACHE_WORDS:
                self.known.update(new)
            found = [f or new[w] for w, f in zip(words, found)]
        return " ".join([f[0] for f in found]), " ".join([f[1] for f in found]), sum([f[2] for f in found])


@lru_cache(maxsize=1)
def coder_of(source: str) -> Bpe:
    """The coder of this worker process, which serves many tasks."""
    return Bpe(source)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                     digests_only: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, decoded, n_tokens, ids_sha256, decoded_sha256), one row per input row.

    Map-only: whole texts in Arrow batches, no shuffle. The vocabulary file is read once on the driver and broadcast;
    it is a fixed input of a few MB and refused above VOCABULARY_BYTES. With `digests_only` the ids and the decoded text
    are not returned. NULL text counts as empty: no ids, digests of nothing. Other columns are not read.
    """
    with open(vocabulary, encoding="utf-8") as f:
        source = f.read(VOCABULARY_BYTES + 1)
    if len(source) > VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(source)
    base = plain(docs, doc_id=id_col, text=text_col)
    kind = dict(base.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                done = [coder.encoded(t or "") for t in part.column("text").to_pylist()]
                cols = [part.column("doc_id")]
                if not digests_only:
                    cols += [pa.array([list(map(int, d[0].split())) for d in done], pa.list_(pa.int32())), pa.array([d[1] for d in done], pa.string())]
                cols += [pa.array([d[2] for d in done], pa.int64()),
                         *[pa.array([hashlib.sha256(d[k].encode()).hexdigest() for d in done], pa.string()) for k in (0, 1)]]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", *([] if digests_only else ["ids", "decoded"]), "n_tokens", "ids_sha256", "decoded_sha256"]
    middle = "" if digests_only else "ids array<int>, decoded string, "
    return base.mapInArrow(run, f"doc_id {kind}, {middle}n_tokens bigint, ids_sha256 string, decoded_sha256 string")
