"""Language ID with a byte convolutional network: trained in numpy, applied to fixed-length windows of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import plain

WINDOW = 256
WIDTHS = (2, 3, 4)
EMBED, FILTERS = 8, 16
AT_ONCE = 256
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class Network:
    """Embedding of bytes, filters of several widths with max pooling over the window, softmax over languages."""

    names: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    head: np.ndarray
    head_bias: np.ndarray

    @staticmethod
    def new(names: list[str], rng: np.random.Generator) -> Network:
        size = lambda *s: rng.normal(0, 1, s).astype(np.float32)
        return Network(names, size(256, EMBED) * 0.5, [size(w * EMBED, FILTERS) / np.sqrt(w * EMBED).astype(np.float32) for w in WIDTHS],
                       [np.zeros(FILTERS, np.float32) for _ in WIDTHS], size(len(WIDTHS) * FILTERS, len(names)) * 0.1,
                       np.zeros(len(names), np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.head, self.head_bias]

    def step(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean log loss of a batch of windows, in the order of parts()."""
        n, width = x.shape
        e = self.embed[x]
        columns, where, pooled = [], [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            c = np.concatenate([e[:, k:width - w + 1 + k] for k in range(w)], axis=2)
            z = c @ f + b
            top = z.argmax(axis=1)
            columns.append(c)
            where.append(top)
            pooled.append(np.take_along_axis(z, top[:, None, :], axis=1)[:, 0])
        raw = np.concatenate(pooled, axis=1)
        hidden = np.maximum(raw, 0)
        logit = hidden @ self.head + self.head_bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.head.T) * (raw > 0)
        d_embed, d_filters, d_bias = np.zeros_like(self.embed), [], []
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            d = back[:, i * FILTERS:(i + 1) * FILTERS]
            best = columns[i][np.arange(n)[:, None], where[i]]
            d_filters.append(np.einsum("njc,nj->cj", best, d))
            d_bias.append(d.sum(axis=0))
            reach = d[:, :, None] * f.T[None]
            for k in range(w):
                np.add.at(d_embed, x[np.arange(n)[:, None], where[i] + k], reach[:, :, k * EMBED:(k + 1) * EMBED])
        return [d_embed, *d_filters, *d_bias, hidden.T @ p, p.sum(axis=0)]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int, rng: np.random.Generator, rate: float = 0.01) -> None:
        """Adam over random batches of windows that are cut short at random, so that short texts are known too."""
        first, second = [np.zeros_like(p) for p in self.parts()], [np.zeros_like(p) for p in self.parts()]
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            rows = x[pick].copy()
            cut = rng.integers(8, WINDOW + 1, batch)
            rows[(np.arange(WINDOW)[None, :] >= cut[:, None]) & (rng.random(batch) < 0.5)[:, None]] = 0
            for p, g, m, v in zip(self.parts(), self.step(rows, y[pick]), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (1 - 0.9 * t / steps)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)


class Reader:
    """The trained network as tables over pairs of bytes: a filter of width w is a sum over byte pairs (and a last byte
    for odd widths), so a window needs look-ups and sums only."""

    def __init__(self, net: Network):
        self.net = net
        self.tables = []
        for w, f in zip(WIDTHS, net.filters):
            one = [net.embed @ f[k * EMBED:(k + 1) * EMBED] for k in range(w)]
            pairs = [(k, (one[k][:, None, :] + one[k + 1][None, :, :]).reshape(1 << 16, FILTERS)) for k in range(0, w - 1, 2)]
            self.tables.append((w, pairs, one[-1] if w % 2 else None))

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Chance of each language for each window."""
        width = x.shape[1]
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        pooled = []
        for (w, pairs, last), b in zip(self.tables, self.net.bias):
            span = width - w + 1
            z = pairs[0][1][pair[:, :span]]
            for k, t in pairs[1:]:
                z += t[pair[:, k:k + span]]
            if last is not None:
                z += last[x[:, w - 1:w - 1 + span]]
            pooled.append(np.maximum(z.max(axis=1) + b, 0))
        logit = np.concatenate(pooled, axis=1) @ self.net.head + self.net.head_bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and chance of each text: the mean over all its windows, weighted by their length. The windows of
        many texts are scored together, AT_ONCE at a time."""
        total = np.zeros((len(texts), len(self.net.names)))
        told = [bool(t) and LETTER.search(t) is not None for t in texts]
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> None:
            if waiting:
                x, owner, weight = (np.concatenate(c) for c in zip(*waiting))
                for at in range(0, len(x), AT_ONCE):
                    part = slice(at, at + AT_ONCE)
                    np.add.at(total, owner[part], self.chances(x[part]) * weight[part, None])
                waiting.clear()

        for i, t in enumerate(texts):
            if told[i]:
                data = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
                rows = -(-len(data) // WINDOW)
                x = np.zeros(rows * WINDOW, np.uint8)
                x[:len(data)] = data
                weight = np.full(rows, WINDOW, np.float64)
                weight[-1] = len(data) - (rows - 1) * WINDOW
                waiting.append((x.reshape(rows, WINDOW), np.full(rows, i), weight / len(data)))
                held += rows
                if held > 16 * AT_ONCE:
                    flush()
                    held = 0
        flush()
        best = total.argmax(axis=1)
        return [(self.net.names[b], float(min(1.0, r[b]))) if ok else (UNKNOWN, 0.0) for ok, b, r in zip(told, best, total)]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 1000,
          windows_per_doc: int = 4, max_langs: int = 200, steps: int = 600, batch: int = 64, seed: int = 7) -> Network | None:
    """The network fitted on a bounded sample: of each language the `docs_per_lang` rows with the smallest id hash among
    those that are not held out, `windows_per_doc` windows at hashed places in each. At most docs_per_lang *
    windows_per_doc * max_langs windows reach the driver; more languages than `max_langs` are an error. None without
    labelled text."""
    base = plain(docs, id=id_col, text=text_col, lang=lang_col).filter("lang is not null and id is not null and text rlike '\\\\p{L}'")
    base = base.filter(~held_out("id"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    room = F.greatest(F.lit(1), F.length("text") - WINDOW + 1)
    cuts = [F.substring(F.col("text"), (F.pmod(F.xxhash64("id", F.lit(k)), room) + 1).cast("int"), F.lit(WINDOW)) for k in range(windows_per_doc)]
    taken = (base.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= docs_per_lang)
             .select("lang", "place", F.array_distinct(F.array(*cuts)).alias("cuts")))
    rows = taken.limit(docs_per_lang * max_langs + 1).collect()
    names = sorted({r.lang for r in rows})
    if len(names) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not rows:
        return None
    place = {n: i for i, n in enumerate(names)}
    pieces = sorted((r.lang, r.place, c) for r in rows for c in r.cuts if c)
    x = np.zeros((len(pieces), WINDOW), np.uint8)
    for row, (_, _, c) in zip(x, pieces):
        data = c.encode("utf-8", "replace")[:WINDOW]
        row[:len(data)] = np.frombuffer(data, np.uint8)
    rng = np.random.default_rng(seed)
    net = Network.new(names, rng)
    net.fit(x, np.array([place[p[0]] for p in pieces]), steps, batch, rng)
    return net


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with `lang_pred` and `score` after them (columns of these names are replaced).

    Map-only: whole texts in Arrow batches, cut into windows of WINDOW bytes (the last is padded); the network is a few
    KB and broadcast. Text without a letter, NULL or empty gets `und` with score 0, as does every text if there is no
    network. Rows are kept as they are, repeated ones too.
    """
    docs = docs.drop("lang_pred", "score")
    if net is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                said = reader.judge(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([s[0] for s in said], pa.string()),
                                                  pa.array([s[1] for s in said], pa.float64())], [*part.schema.names, "lang_pred", "score"])

    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(run, schema)
