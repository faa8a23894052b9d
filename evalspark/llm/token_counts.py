"""Token counts of a byte-level BPE vocabulary by a deterministic transducer compiled as texts need it.

Reading a text, the transducer holds the open tokens of the current word: each is a path in the vocabulary's trie, the
token before it and its count. A letter moves every open token one step on; among those that end there exactly one is
compatible with the token before it, and the count up to here follows from it. A transition is annotated with the change
of that count, so adding annotations up is counting tokens. States and transitions are made at their first use and kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.bpe import VOCABULARY_BYTES, byte_letters
from evalspark.llm.common import document_key, plain

CHUNK = 1 << 16
STATES = 200_000
NEVER = 1 << 60

# The word rules of the vocabulary's pre-tokenizer, by kind of letter.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
SPACE, LETTER, NUMBER, OTHER = "W", "L", "N", "O"
KINDS = regex.compile(r"(\p{White_Space})|(\p{L})|(\p{N})")
# Places where one word surely ends and another begins, whatever stands before.
SURE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=[^\p{L}\p{White_Space}])|(?<=\p{N})(?=[^\p{N}\p{White_Space}])"
                     r"|(?<=[^\p{L}\p{N}\p{White_Space}'])(?=[\p{L}\p{N}])|(?<=')(?=\p{N})")


class Vocabulary:
    """Trie, merge ranks and compatibility of neighbouring tokens."""

    def __init__(self, source: str):
        spec = json.loads(source)
        value = {letter: b for b, letter in enumerate(byte_letters())}
        as_bytes = {t: bytes(value[x] for x in t) for t in spec["model"]["vocab"] if all(x in value for x in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(as_bytes[a], as_bytes[b]): r for r, (a, b) in reversed(list(enumerate(merges)))}
        self.made = {a + b: (r, (a, b)) for (a, b), r in self.rank.items()}
        self.spines: tuple[dict, dict] = ({}, {})
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in as_bytes.values():
            at = 0
            for b in t:
                if b not in self.trie[at]:
                    self.trie[at][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(None)
                at = self.trie[at][b]
            self.token[at] = t
        self.fit: dict[tuple[bytes, bytes], bool] = {}

    def spine(self, token: bytes, side: int) -> list[tuple[int, bytes]]:
        """The tokens that stand at the right (1) or left (0) end of a token while it is built, each with the rank of the
        merge that ends it; the token itself comes last and never ends."""
        found = self.spines[side].get(token)
        if found is None:
            parts, last = [], NEVER
            at = token
            while True:
                parts.append((last, at))
                made = self.made.get(at)
                if made is None:
                    break
                last, at = made[0], made[1][side]
            found = self.spines[side][token] = parts[::-1]
        return found

    def fits(self, before: bytes, token: bytes) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded as one word: while both are built, no
        merge across the seam may come first. Of equal ranks the left place merges first."""
        known = self.fit.get((before, token))
        if known is None:
            if len(self.fit) > 4 * STATES:
                self.fit.clear()
            known = self.fit[before, token] = self.seam_holds(before, token) if before else True
        return known

    def seam_holds(self, before: bytes, token: bytes) -> bool:
        left, right = self.spine(before, 1), self.spine(token, 0)
        i = j = 0
        while True:
            (end_left, a), (end_right, b) = left[i], right[j]
            across = self.rank.get((a, b), NEVER)
            if across < end_left and across <= end_right and across < NEVER:
                return False
            if end_left == NEVER and end_right == NEVER:
                return True
            if end_left <= end_right:
                i += 1
            else:
                j += 1


Open = tuple[tuple[int, bytes, int], ...]
FRESH: Open = ((0, b"", 0),)


class State(dict):
    """A state of the transducer: letter -> (next state, change of the token count). Missing transitions are compiled.
    `jumps` holds composed transitions over frequent letters between blanks, the blank after them included."""

    __slots__ = ("machine", "mode", "open", "held", "jumps")

    def __init__(self, machine: Transducer, mode: str, open_: Open, held: str):
        self.machine, self.mode, self.open, self.held = machine, mode, open_, held
        self.jumps: dict[str, tuple[State, int]] | None = None

    def __missing__(self, letter: str) -> tuple[State, int]:
        out = self[letter] = self.machine.step(self, letter)
        return out


class Transducer:
    def __init__(self, source: str):
        self.vocabulary = Vocabulary(source)
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple[str, Open, str], State] = {}
        self.start = self.state("", FRESH, "")
        self.n_jumps = 0

    def state(self, mode: str, open_: Open, held: str) -> State:
        key = (mode, open_, held)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, mode, open_, held)
        return found

    def feed(self, open_: Open, text: str) -> tuple[Open, int]:
        """The open tokens after more letters of the same word, and the change of the count. Counts in `open_` are
        relative to the count so far."""
        v, total = self.vocabulary, 0
        for b in text.encode("utf-8"):
            moved, last = [], None
            for at, before, count in open_:
                to = v.trie[at].get(b)
                if to is None:
                    continue
                if last is None and (t := v.token[to]) is not None and v.fits(before, t):
                    last = (t, count + 1)
                if v.trie[to]:
                    moved.append((to, before, count))
            token, now = last
            open_ = (*[(to, before, count - now) for to, before, count in moved], (0, token, 0))
            total += now
        return open_, total

    def begin(self, letter: str, kind: str) -> tuple[State, int]:
        if kind == SPACE:
            return self.state(SPACE, FRESH, letter), 0
        open_, n = self.feed(FRESH, letter)
        return self.state("'" if letter == "'" else kind, open_, ""), n

    def step(self, s: State, letter: str) -> tuple[State, int]:
        """One transition. `held` letters are read but not yet given to a word: the last of a run of spaces, which
        opens the next word if it is a blank, or the first letter of a contraction of two."""
        m = KINDS.match(letter)
        kind = OTHER if m is None else (SPACE, LETTER, NUMBER)[m.lastindex - 1]
        if s.mode == kind and kind != SPACE:
            open_, n = self.feed(s.open, letter)
            return self.state(kind, open_, ""), n
        if s.mode == SPACE:
            if kind == SPACE:
                open_, n = self.feed(s.open, s.held)
                return self.state(SPACE, open_, letter), n
            if s.held == " ":
                open_, n = self.feed(FRESH, " " + letter)
                return self.state(kind, open_, ""), n
            n = self.feed(FRESH, s.held)[1]
        elif s.mode == "'" and not s.held:
            if letter in CONTRACTIONS:
                return self.start, self.feed(s.open, letter)[1]
            if any(c[0] == letter for c in CONTRACTIONS):
                return self.state("'", s.open, letter), 0
            if kind == OTHER:
                open_, n = self.feed(s.open, letter)
                return self.state(OTHER, open_, ""), n
            n = 0
        elif s.held:
            if s.held + letter in CONTRACTIONS:
                return self.start, self.feed(s.open, s.held + letter)[1]
            word, n = self.begin(s.held, LETTER)
            to, more = word[letter]
            return to, n + more
        else:
            n = 0
        to, more = self.begin(letter, kind)
        return to, n + more

    def close(self, s: State) -> int:
        """The change of the count when the text ends here."""
        return self.feed(s.open if s.mode == SPACE else FRESH, s.held)[1] if s.held else 0

    def jump(self, s: State, letters: str) -> tuple[State, int]:
        """The transition over some letters and a blank. Those met first, the frequent ones, are kept as one."""
        to, n = s, 0
        for letter in letters:
            to, change = to[letter]
            n += change
        to, change = to[" "]
        if self.n_jumps < STATES and len(letters) < 64:
            if s.jumps is None:
                s.jumps = {}
            s.jumps[letters] = to, n + change
            self.n_jumps += 1
        return to, n + change

    def run(self, text: str) -> int:
        if len(self.states) > STATES:
            self.reset()
        s, n = self.start, 0
        *parts, last = text.split(" ")
        for letters in parts:
            s, change = (s.jumps and s.jumps.get(letters)) or self.jump(s, letters)
            n += change
        for letter in last:
            s, change = s[letter]
            n += change
        return n + self.close(s)

    def count(self, text: str) -> int:
        """Tokens of a text; strings of special tokens in it are one token each."""
        marks = self.vocabulary.marks
        if marks is None or not marks.search(text):
            return self.run(text)
        parts = marks.split(text)
        return sum(map(self.run, parts)) + len(parts) - 1

    # A chunk's state map is (head, count, tail, open). From any state, the text up to the chunk's first sure word end
    # (head) leads to the start state; `count` tokens lie between that and the last sure word end; the state at the chunk's
    # end is the one that `tail` leads to from the start. A chunk without a sure word end is all head, `open` is true.

    def chunk_map(self, text: str) -> tuple[str, int, str, bool]:
        cuts = [m.start() for m in SURE.finditer(text)]
        if not cuts:
            return text, 0, "", True
        return text[:cuts[0]], self.run(text[cuts[0]:cuts[-1]]), text[cuts[-1]:], False

    def compose(self, a: tuple[str, int, str, bool], b: tuple[str, int, str, bool]) -> tuple[str, int, str, bool]:
        """The map of two neighbouring chunks; it is associative. Letters that meet may form a new sure word end, so what
        lies between the inner parts is mapped anew."""
        if a[3] and b[3]:
            return self.chunk_map(a[0] + b[0])
        if a[3]:
            head, n, tail, all_head = self.chunk_map(a[0] + b[0])
            return (head, b[1], b[2], False) if all_head else (head, n + self.run(tail) + b[1], b[2], False)
        if b[3]:
            head, n, tail, all_head = self.chunk_map(a[2] + b[0])
            return (a[0], a[1], head, False) if all_head else (a[0], a[1] + self.run(head) + n, tail, False)
        return a[0], a[1] + self.run(a[2] + b[0]) + b[1], b[2], False

    def scan(self, maps: list[tuple[str, int, str, bool]]) -> list[tuple[str, int, str, bool]]:
        """Maps of all prefixes, by doubling steps: every step composes each map with the one `step` places before."""
        out, step = list(maps), 1
        while step < len(out):
            out = out[:step] + [self.compose(out[i - step], out[i]) for i in range(step, len(out))]
            step *= 2
        return out

    def total(self, maps: list[tuple[str, int, str, bool]]) -> int:
        """Tokens of the text of all maps, by a balanced tree of compositions."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail, _ = maps[0]
        return self.run(head) + n + self.run(tail)


@lru_cache(maxsize=1)
def transducer_of(source: str) -> Transducer:
    """The transducer of this worker process, which serves many tasks."""
    return Transducer(source)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        source = f.read(VOCABULARY_BYTES + 1)
    if len(source) > VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to broadcast")
    return source


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, chunk: int = CHUNK, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row.

    Texts of up to `chunk` letters are counted where they are read, without a shuffle. Longer ones are cut into chunks that
    all tasks share; a chunk becomes its state map, and the maps of one text, small beside it, are composed in a tree.
    NULL text counts as empty: 0 tokens. NULL and repeated ids are kept, one row each: chunks are grouped by id and digest
    of the text, and a text that occurs k times under one id gives k rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    base = plain(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = dict(base.dtypes)["doc_id"]
    special = max((len(t["content"]) for t in json.loads(shared.value)["added_tokens"]), default=0)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer_of(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = [machine.count(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())],
                                                 ["doc_id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of long texts, numbered; a special token's string is a chunk of its own."""
        marks = transducer_of(shared.value).vocabulary.marks
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                spans, at = [], 0
                for m in marks.finditer(text) if marks else ():
                    spans += [(s, min(s + chunk, m.start()), False) for s in range(at, m.start(), chunk)] + [(*m.span(), True)]
                    at = m.end()
                spans += [(s, min(s + chunk, len(text)), False) for s in range(at, len(text), chunk)]
                for j in range(0, len(spans), 64):
                    some = spans[j:j + 64]
                    same = pa.array([i] * len(some))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(c).take(same) for c in ("doc_id", "n_bytes", "key")]
                        + [pa.array(range(j, j + len(some)), pa.int32()), pa.array([text[s:e] for s, e, _ in some]), pa.array([m for *_, m in some])],
                        ["doc_id", "n_bytes", "key", "i", "part", "mark"])

    def to_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer_of(shared.value)
        for batch in batches:
            maps = [("", 0, "", True) if mark else machine.chunk_map(t)
                    for t, mark in zip(batch.column("part").to_pylist(), batch.column("mark").to_pylist())]
            cols = [pa.array([m[k] for m in maps], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "n_bytes", "key", "i", "mark")] + cols, mapped)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer_of(shared.value)
        for batch in batches:
            n = []
            for maps in batch.column("maps").to_pylist():
                tokens, run = 0, []
                for m in [*maps, {"mark": None}]:
                    if m["mark"] is False:
                        run.append((m["head"], m["inner"], m["tail"], m["open"]))
                        continue
                    tokens += (machine.total(run) if run else 0) + (m["mark"] is True)
                    run = []
                n.append(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), batch.column("copies")],
                                             ["doc_id", "n_bytes", "n_tokens", "copies"])

    mapped = ["doc_id", "n_bytes", "key", "i", "mark", "head", "inner", "tail", "open"]
    sized = base.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    short = sized.filter(F.char_length("text") <= max(chunk, special)).mapInArrow(whole, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    parts = sized.filter(F.char_length("text") > max(chunk, special)).withColumn("key", document_key()).mapInArrow(
        cut, f"doc_id {kind}, n_bytes bigint, key binary, i int, part string, mark boolean")
    maps = parts.repartition(F.col("key"), F.col("i")).mapInArrow(
        to_maps, f"doc_id {kind}, n_bytes bigint, key binary, i int, mark boolean, head string, inner bigint, tail string, open boolean")
    # rows that repeat an id and a text give equal maps: one of each is kept and their number counted
    one = maps.groupBy("key", "i").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("doc_id", "n_bytes", "mark", "head", "inner", "tail", "open")])
    long = one.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.first("copies").alias("copies"),
                                  F.array_sort(F.collect_list(F.struct("i", "mark", "head", "inner", "tail", "open"))).alias("maps"))
    long = long.select("doc_id", "n_bytes", "copies", "maps").mapInArrow(composed, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, copies bigint")
    long = long.withColumn("__one", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
