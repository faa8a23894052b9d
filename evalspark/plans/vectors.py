"""Resampling with one dense vector of draws per unit.

All draws of a unit travel as one binary value of 16-bit weights, so the rows that are shuffled do not depend on the
number of draws. Scores are reduced to one vector per (group, label, score) by sums over rows of a matrix, as far as each
task has them, and a sorted pass per group turns them into the ranking metrics of every draw at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import HASH_SCALE
from evalspark.functions.digests import md5_heads
from evalspark.plans.groups import HOT_ROWS, join_skewed
from evalspark.plans.lineage import stored

BLOCK = 1024  # units whose weights one matrix holds
HASHED = 200_000  # picks hashed at once
PICKS = 4_000_000  # picks held before they are sent to their units
CELLS = 8_000_000  # vector entries held at once
SUMS = 4  # times as many narrow entries may be summed into
GROUP_ROWS = 500_000  # summed rows of a group beyond which its scores are cut into segments
MOST_DRAWS = 1 << 22


def as_binary(rows: np.ndarray) -> pa.Array:
    """A binary value per row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())


def as_matrix(column: pa.Array, kind) -> np.ndarray:
    """The matrix of a column of equally long binary values without NULLs."""
    wide = column.cast(pa.large_binary())
    _, ends, data = wide.buffers()
    lo, hi = np.frombuffer(ends, np.int64)[[wide.offset, wide.offset + len(wide)]]
    return np.frombuffer(data, np.uint8)[lo:hi].view(kind).reshape(len(column), -1)


def key_of(columns: Sequence[str]):
    return F.to_json(F.struct(*columns)) if columns else F.lit("{}")


def fields(df: DataFrame, columns: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in columns)


def packed_counts(m: np.ndarray) -> pa.Array:
    """Vectors of counts in the narrowest of 2, 4 and 8 bytes that holds them all; the length tells which."""
    top = m.max(initial=0)
    return as_binary(m.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64))


def counts_matrix(column: pa.Array, width: int) -> np.ndarray:
    """The matrix of a column of packed counts; NULL is all zeros."""
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column.to_pylist()):
        if v is not None:
            out[i] = np.frombuffer(v, {2: np.uint16, 4: np.uint32, 8: np.int64}[len(v) // width])
    return out


# --- draws ---

def draw_vectors(U: DataFrame, n_boot: int, seed: int, strata: Sequence[str], unit: str) -> DataFrame:
    """(stratum, unit, rows, w): w holds n_boot + 1 weights of 16 bits, first the observed weight 1. Every unit's slot
    picks one unit per draw; a task gathers its picks by block of units, and a block adds them up in a matrix."""
    if n_boot >= MOST_DRAWS:
        raise ValueError("too many draws")
    strata = list(strata)
    slots = U.select(*strata, F.concat_ws(":", *[F.col(c).cast("string") for c in strata], F.lit("")).alias("__prefix"), "idx", "n")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        begun: dict[str, tuple] = {}  # per stratum, what is hashed of each draw before the slot's number, and its sizes
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for values, parts in held.items():
                places = np.concatenate(parts)
                draws = np.tile(np.arange(n_boot), len(parts))
                order = np.argsort(places, kind="stable")
                places, draws = places[order], draws[order]
                blocks, starts = np.unique(places // BLOCK, return_index=True)
                entries = ((places % BLOCK) << 22 | draws).astype(np.uint32)
                cut = np.split(entries, starts[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v] * len(blocks), slots_types[i]) for i, v in enumerate(values)]
                    + [pa.array(blocks, pa.int64()), pa.array([c.tobytes() for c in cut], pa.binary())], [*strata, "__block", "__entries"])

        for batch in batches:
            slots_types = [batch.schema.field(c).type for c in strata]
            rows = list(zip(*[batch.column(c).to_pylist() for c in (*strata, "__prefix", "idx", "n")]))
            step = max(1, HASHED // max(1, n_boot))
            for part in (rows[i:i + step] for i in range(0, len(rows), step)):
                messages, sizes = [], []
                for *_, prefix, idx, _ in part:
                    if prefix not in begun:
                        heads = [f"{prefix}{d}".encode() for d in range(n_boot)]
                        begun[prefix] = [*heads, b""], np.array([len(h) for h in heads])
                    tail = f":{idx}:{seed}".encode()
                    messages.append(tail.join(begun[prefix][0]))
                    sizes.append(begun[prefix][1] + len(tail))
                u = (md5_heads(b"".join(messages), np.concatenate(sizes)) >> np.uint64(12)).astype(np.float64) / HASH_SCALE
                n = np.array([r[-1] for r in part])[:, None]
                for row, places in zip(part, np.minimum(np.floor(u.reshape(len(part), n_boot) * n).astype(np.int64), n - 1)):
                    held.setdefault(tuple(row[:len(strata)]), []).append(places)
                size += n_boot * len(part)
            if size >= PICKS:
                yield from flush()
                held, size = {}, 0
        if size:
            yield from flush()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, m = None, np.zeros((BLOCK, n_boot), np.int32)
        for batch in batches:
            keys = list(zip(batch.column("__key").to_pylist(), batch.column("__block").to_pylist()))
            entries, local = batch.column("__entries").to_pylist(), batch.column("__local").to_pylist()
            done, weights = [], []
            for i, key in enumerate(keys):
                if key != at:
                    at = key
                    m[:] = 0
                if entries[i] is not None:
                    e = np.frombuffer(entries[i], np.uint32)
                    np.add.at(m.reshape(-1), (e >> 22).astype(np.int64) * n_boot + (e & (MOST_DRAWS - 1)), 1)
                else:
                    done.append(i)
                    weights.append(m[local[i]].copy())
            if done:
                w = np.ones((len(done), n_boot + 1), np.int32)
                w[:, 1:] = weights
                if w.max() > 32767:
                    raise ValueError("a unit's weight does not fit 16 bits")
                rows = batch.take(pa.array(done))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in (*strata, unit, "rows")], as_binary(w.astype(np.int16))],
                                                 [*strata, unit, "rows", "w"])

    # few bytes, but much work: Spark would put the slots together into one task
    parts = int(U.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picked = slots.repartition(parts).mapInArrow(pick, f"{fields(U, strata)}__block bigint, __entries binary")
    kinds = dict(U.dtypes)
    both = picked.select(*strata, "__block", "__entries", F.lit(None).cast("int").alias("__local"), F.lit(None).cast(kinds[unit]).alias(unit),
                         F.lit(None).cast("bigint").alias("rows")).unionByName(
        U.select(*strata, F.floor(F.col("idx") / BLOCK).alias("__block"), F.lit(None).cast("binary").alias("__entries"),
                 (F.col("idx") % BLOCK).cast("int").alias("__local"), unit, F.col("rows").cast("bigint").alias("rows")))
    both = both.withColumn("__key", key_of(strata))
    both = both.repartition("__key", "__block").sortWithinPartitions("__key", "__block", F.col("__local").asc_nulls_first())
    return both.mapInArrow(add_up, f"{fields(U, strata)}`{unit}` {kinds[unit]}, rows bigint, w binary")


def unpacked(vectors: DataFrame, n_boot: int, strata: Sequence[str], unit: str) -> DataFrame:
    """(stratum, unit, draw, weight) of the weights above 0, without the observed one."""
    strata = list(strata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CELLS // (n_boot + 1))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                m = as_matrix(part.column("w"), np.int16)[:, 1:]
                row, draw = np.nonzero(m)
                for j in range(0, len(row), 100_000):
                    r, d = row[j:j + 100_000], draw[j:j + 100_000]
                    yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(r)) for c in (*strata, unit)], pa.array(d.astype(np.int32)),
                                                      pa.array(m[r, d].astype(np.int64))], [*strata, unit, "draw", "weight"])

    return vectors.select(*strata, unit, "w").mapInArrow(run, f"{fields(vectors, [*strata, unit])}draw int, weight bigint")


def draw_totals(vectors: DataFrame, n_boot: int, strata: Sequence[str]) -> DataFrame:
    """(stratum, draw, drawn, total, most): units with a weight above 0, the sum of the weights and the largest, as far as each
    task has them by sums over rows of a matrix."""
    strata = list(strata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for values, t in held.items():
                yield pa.RecordBatch.from_arrays([*[pa.array([v] * n_boot, k) for v, k in zip(values, kinds)], pa.array(np.arange(n_boot, dtype=np.int32)),
                                                  *map(pa.array, t)], [*strata, "draw", "drawn", "total", "most"])
            held.clear()

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in strata]
            step = max(1, CELLS // (n_boot + 1))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                m = as_matrix(part.column("w"), np.int16)[:, 1:]
                rows: dict[tuple, list] = {}
                for k, values in enumerate(zip(*[part.column(c).to_pylist() for c in strata]) if strata else [()] * len(part)):
                    rows.setdefault(values, []).append(k)
                for values, at in rows.items():
                    own, t = m[at], held.setdefault(values, np.zeros((3, n_boot), np.int64))
                    t[0] += (own > 0).sum(axis=0)
                    t[1] += own.sum(axis=0, dtype=np.int64)
                    t[2] = np.maximum(t[2], own.max(axis=0))
                if len(held) * n_boot > CELLS // 4:
                    yield from flush()
        if held:
            yield from flush()

    sums = vectors.select(*strata, "w").mapInArrow(run, f"{fields(vectors, strata)}draw int, drawn bigint, total bigint, most bigint")
    return sums.groupBy(*strata, "draw").agg(F.sum("drawn").alias("drawn"), F.sum("total").alias("total"), F.max("most").alias("most")).filter("drawn > 0")


# --- metrics of all draws ---

class Groups:
    """Numbers for group keys, with the values of their columns."""

    def __init__(self, columns: Sequence[str]):
        self.columns, self.number, self.values, self.types = columns, {}, [], None

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        keys = batch.column("__key").dictionary_encode()
        self.types = [batch.schema.field(c).type for c in self.columns]
        first = {}
        index = keys.indices.to_numpy(zero_copy_only=False)
        places, at = np.unique(index, return_index=True)
        for p, i in zip(places, at):
            key = keys.dictionary[int(p)].as_py()
            if key not in self.number:
                self.number[key] = len(self.values)
                self.values.append([batch.column(c)[int(i)].as_py() for c in self.columns])
            first[p] = self.number[key]
        return np.array([first[p] for p in places], np.int64)[np.searchsorted(places, index)]

    def arrays(self, codes) -> list[pa.Array]:
        return [pa.array([self.values[c][k] for c in codes], t) for k, t in enumerate(self.types)]


def score_vectors(cells: DataFrame, by: Sequence[str], draws: int) -> DataFrame:
    """(group, p, pos, neg): sums of weight vectors per (group, label, score), as far as each task has them; the vector of the
    other label is NULL. `cells` holds (group, y, p, w). A task adds its rows to one matrix with a row per (group, label,
    score) that it has met, and sends the matrix on when it is full."""
    by = list(by)
    width = draws + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, places, most = Groups(by), {}, 0
        m = np.zeros((1024, width), np.int32)

        def emit() -> Iterator[pa.RecordBatch]:
            sides, scores = (np.array(k) for k in zip(*places))
            scores = scores.view(np.float64)
            step = max(1, CELLS // (8 * width))
            for i in range(0, len(sides), step):
                s = slice(i, min(i + step, len(sides)))
                counts, one = packed_counts(m[s]), pa.array(sides[s] % 2 == 1)
                none = pa.scalar(None, counts.type)
                yield pa.RecordBatch.from_arrays([*groups.arrays(sides[s] // 2), pa.array(scores[s]), pc.if_else(one, counts, none),
                                                  pc.if_else(one, none, counts)], [*by, "p", "pos", "neg"])

        for batch in batches:
            step = min(max(1, CELLS // (4 * width)), 1 << 15)
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                w = as_matrix(part.column("w"), np.int16)
                more = len(w) * int(w.max())
                if most + more >= 1 << 31 or len(places) * width > SUMS * CELLS:  # before a sum could pass 32 bits, or no room
                    yield from emit()
                    places, most = {}, 0
                    m[:] = 0
                most += more
                p = part.column("p").to_numpy(zero_copy_only=False) + 0.0  # one zero
                bits = np.where(np.isnan(p), np.nan, p).view(np.int64)  # and one NaN
                side = groups.codes(part) * 2 + (part.column("y").to_numpy() == 1)
                order = np.lexsort((bits, side))
                bits, side = bits[order], side[order]
                new = np.flatnonzero(np.concatenate(([True], (side[1:] != side[:-1]) | (bits[1:] != bits[:-1]))))
                at = np.array([places.setdefault(k, len(places)) for k in zip(side[new].tolist(), bits[new].tolist())])
                if len(places) > len(m):
                    grown = np.zeros((max(len(places), 2 * len(m)), width), np.int32)
                    grown[:len(m)] = m
                    m = grown
                times = np.diff(np.append(new, len(order)))
                if times.max() > 8:
                    m[at] += np.add.reduceat(w[order], new, axis=0, dtype=np.int32)
                else:  # rows that share no key are added without a copy in wide numbers
                    for k in range(times.max()):
                        has = times > k
                        m[at[has]] += w[order[new[has] + k]]
        if places:
            yield from emit()

    kept = cells.select(*by, F.col("y").cast("int").alias("y"), F.col("p").cast("double").alias("p"), "w").withColumn("__key", key_of(by))
    return kept.mapInArrow(run, f"{fields(cells, by)}p double, pos binary, neg binary")


def _segment_starts(hist: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """(group, seg, pos, neg): the counts above each segment of its group."""
    by = list(by)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, sums = Groups(by), {}
        for batch in batches:
            codes, segs = groups.codes(batch), batch.column("seg").to_pylist()
            for c, s, p, n in zip(codes, segs, counts_matrix(batch.column("pos"), width), counts_matrix(batch.column("neg"), width)):
                old = sums.get((c, s))
                sums[c, s] = (p, n) if old is None else (old[0] + p, old[1] + n)
        if sums:
            yield pa.RecordBatch.from_arrays([*groups.arrays([c for c, _ in sums]), pa.array([s for _, s in sums], pa.int32()),
                                              packed_counts(np.array([p for p, _ in sums.values()])), packed_counts(np.array([n for _, n in sums.values()]))],
                                             [*by, "seg", "pos", "neg"])

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seg = None, None
        run = np.zeros((2, width), np.int64)
        here = np.zeros((2, width), np.int64)
        for batch in batches:
            starts = []
            for key, s, p, n in zip(batch.column("__key").to_pylist(), batch.column("seg").to_pylist(),
                                    counts_matrix(batch.column("pos"), width), counts_matrix(batch.column("neg"), width)):
                if key != at:
                    at, seg, run, here = key, s, np.zeros((2, width), np.int64), np.zeros((2, width), np.int64)
                elif s != seg:
                    seg, run, here = s, run + here, np.zeros((2, width), np.int64)
                here = here + np.array([p, n])
                starts.append(run)
            if starts:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*by, "seg")], packed_counts(np.array([s[0] for s in starts])),
                                                  packed_counts(np.array([s[1] for s in starts]))], [*by, "seg", "pos", "neg"])

    kind = f"{fields(hist, by)}seg int, pos binary, neg binary"
    part = hist.select(*by, "seg", "pos", "neg").withColumn("__key", key_of(by)).mapInArrow(totals, kind).withColumn("__key", key_of(by))
    part = part.repartition("__key").sortWithinPartitions("__key", F.col("seg").desc())
    return part.mapInArrow(above, kind).dropDuplicates([*by, "seg"])


def score_sums(P: DataFrame, weights: DataFrame, n_boot: int, by: Sequence[str], strata: Sequence[str], unit: str) -> DataFrame:
    """`score_vectors` of all rows of P with the weights of their units, as a stored table. P is read once and, unless a unit
    is hot, shuffled once."""
    on = [*strata, unit]
    cells = P.select(*dict.fromkeys([*by, *on, "y", "p"]))
    vectors = weights.select(*on, "rows", "w")
    if vectors.filter(F.col("rows") > HOT_ROWS).isEmpty():
        joined = cells.join(vectors.drop("rows").hint("merge"), on)
    else:
        joined = join_skewed(cells, vectors, on, "rows")
    return stored(score_vectors(joined, by, n_boot), "sums")


def vector_metrics(P: DataFrame, weights: DataFrame, n_boot: int, by: Sequence[str], strata: Sequence[str], unit: str,
                   threshold: float = 0.5, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`sums_metrics` of the rows of P."""
    return sums_metrics(score_sums(P, weights, n_boot, by, strata, unit), n_boot, by, threshold, group_rows)


def sums_metrics(hist: DataFrame, n_boot: int, by: Sequence[str], threshold: float = 0.5, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Sums per (group, draw) from which the ranking metrics follow: draw (-1 is the observed sample), n_pos, n_neg,
    lost (sum pos * (2 neg at or above - neg tied)), ap (sum of pos * precision), tp, fp at the threshold and `bad` rows
    with an unusable score.

    A group with more than `group_rows` summed rows is cut into segments of scores at common quantiles, and what lies above
    a segment is known before the segment is walked, so no task walks a whole large group.
    """
    by = list(by)
    width = n_boot + 1
    kind = fields(hist, by)
    most = hist.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    segments = -(-most // group_rows)
    bounds = []
    if segments > 1:
        cuts = [k / segments for k in range(1, segments)]
        bounds = sorted(set(hist.select(F.percentile_approx("p", cuts, 100 * segments)).first()[0]))
    seg = reduce(lambda a, b: a + b, [(F.col("p") >= b).cast("int") for b in bounds], F.lit(0))
    hist = hist.withColumn("seg", seg)
    if bounds:
        starts = _segment_starts(hist, by, width).withColumn("p", F.lit(None).cast("double")).withColumn("start", F.lit(True))
        hist = hist.withColumn("start", F.lit(False)).unionByName(starts)
    else:
        hist = hist.withColumn("start", F.lit(False))
    sums = ("n_pos", "n_neg", "lost", "ap", "tp", "fp", "bad")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups(by)
        at, tp, fp, out = None, None, None, None
        held: list[tuple] = []
        size = 0

        def use(last: bool) -> None:
            """Walk the rows held, from high to low scores; the lowest score waits for more rows of its own."""
            nonlocal held, size, tp, fp
            if not held:
                return
            p, pos, neg = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            good = np.isfinite(p)
            out["bad"] += (pos[~good] + neg[~good]).sum(axis=0)
            p, pos, neg = p[good], pos[good], neg[good]
            held, size = [], 0
            if not len(p):
                return
            new = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            p, pos, neg = p[new], np.add.reduceat(pos, new, axis=0), np.add.reduceat(neg, new, axis=0)
            if not last:
                held, size = [(p[-1:], pos[-1:], neg[-1:])], pos[-1:].size
                p, pos, neg = p[:-1], pos[:-1], neg[:-1]
                if not len(p):
                    return
            tps, fps = tp + np.cumsum(pos, axis=0), fp + np.cumsum(neg, axis=0)
            out["n_pos"] += pos.sum(axis=0)
            out["n_neg"] += neg.sum(axis=0)
            out["lost"] += (pos.astype(np.float64) * (2.0 * fps - neg)).sum(axis=0)
            out["ap"] += (pos * (tps / np.maximum(tps + fps, 1))).sum(axis=0)
            hit = p >= threshold
            out["tp"] += pos[hit].sum(axis=0)
            out["fp"] += neg[hit].sum(axis=0)
            tp, fp = tps[-1], fps[-1]

        def close() -> pa.RecordBatch:
            use(True)
            return pa.RecordBatch.from_arrays([*groups.arrays([at[0]]), *[pa.array([out[s]], pa.list_(pa.float64())) for s in sums]], [*by, *sums])

        for batch in batches:
            codes, segs = groups.codes(batch), batch.column("seg").to_numpy()
            start, p = batch.column("start").to_pylist(), batch.column("p").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (segs[1:] != segs[:-1]), [True])))
            for lo, hi in zip(edges, edges[1:]):
                if at != (codes[lo], segs[lo]):
                    if at is not None:
                        yield close()
                    at = (codes[lo], segs[lo])
                    tp, fp = np.zeros(width, np.int64), np.zeros(width, np.int64)
                    out = {s: np.zeros(width) for s in sums}
                step = max(1, CELLS // (8 * width))
                if start[lo]:
                    tp, fp = counts_matrix(batch.column("pos").slice(lo, 1), width)[0], counts_matrix(batch.column("neg").slice(lo, 1), width)[0]
                    lo += 1
                for i in range(lo, hi, step):
                    n = min(step, hi - i)
                    held.append((p[i:i + n], counts_matrix(batch.column("pos").slice(i, n), width), counts_matrix(batch.column("neg").slice(i, n), width)))
                    size += n * width
                    if size > CELLS // 8:
                        use(False)
        if at is not None:
            yield close()

    rows = hist.withColumn("__key", key_of(by)).repartition("__key", "seg").sortWithinPartitions(
        "__key", "seg", F.col("start").desc(), F.col("p").desc())
    done = rows.mapInArrow(walk, kind + ", ".join(f"{s} array<double>" for s in sums))
    flat = done.select(*by, F.posexplode(F.arrays_zip(*sums)).alias("draw", "v")).select(*by, (F.col("draw") - 1).cast("int").alias("draw"), "v.*")
    return flat.groupBy(*by, "draw").agg(*[F.sum(s).alias(s) for s in sums])
