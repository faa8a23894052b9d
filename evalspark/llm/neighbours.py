"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, survivors recomputed in floats."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import plain

QUERY_BLOCK = 4096
TILE_ROWS = 2048
PAIRS_AT_ONCE = 1 << 16
SLACK = 1e-9


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of one length as a matrix of doubles; missing components become NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of one signed byte, scale, norm, and norm of the quantisation error of each row."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, np.sqrt((x * x).sum(axis=1)), error


def coded(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dim, codes, scale, norm, error) of the rows that take part."""
    base = plain(vectors, id=id_col, vec=vec_col).filter("id is not null and size(vec) > 0")
    kinds = dict(base.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(v) for v in batch.column("vec")], dtype=np.int64)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = matrix(part.column("vec"), int(dim))
                part = part.filter(pa.array(ok := np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)))
                if part.num_rows:
                    codes, scale, norm, error = quantise(x[ok])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("vec"), pa.array(np.full(len(scale), dim, np.int32)),
                         pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(norm), pa.array(error)], names)

    names = ["id", "vec", "dim", "codes", "scale", "norm", "error"]
    return base.mapInArrow(run, f"id {kinds['id']}, vec {kinds['vec']}, dim int, codes binary, scale double, norm double, error double")


class Rows:
    """Rows of a tile side as matrices."""

    def __init__(self, batch: pa.RecordBatch, dim: int):
        self.ids = batch.column("id").to_numpy(zero_copy_only=False)
        self.x = matrix(batch.column("vec"), dim)
        exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # products of int8 codes stay whole numbers
        self.codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.int8).reshape(-1, dim).astype(exact)
        self.scale, self.norm, self.error = (batch.column(c).to_numpy() for c in ("scale", "norm", "error"))
        self.coded_norm = self.norm + self.error


class Best:
    """The k best candidates so far of each query of a block: heaps of (score, -id), worst first."""

    def __init__(self, queries: Rows, k: int):
        self.q, self.k = queries, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        self.floor = np.full(len(queries.ids), -np.inf)

    def tile(self, c: Rows) -> None:
        """One tile: int8 products, bounds, survivors recomputed in doubles and merged into the heaps."""
        q = self.q
        about = (q.codes @ c.codes.T).astype(np.float64) * q.scale[:, None] * c.scale[None, :]
        bound = (q.error[:, None] * c.norm[None, :] + q.coded_norm[:, None] * c.error[None, :]) * (1 + SLACK)
        bound += SLACK * q.norm[:, None] * c.norm[None, :]
        floor = self.floor
        if len(c.ids) >= self.k:
            least = about - bound
            least[q.ids[:, None] == c.ids[None, :]] = -np.inf  # merge() drops all rows of the query's id: they raise no floor
            at = len(c.ids) - self.k
            floor = np.maximum(floor, np.partition(least, at, axis=1)[:, at])
        rows, cols = np.nonzero(~(about + bound < floor[:, None]))
        for at in range(0, len(rows), PAIRS_AT_ONCE):
            self.merge(c, rows[at:at + PAIRS_AT_ONCE], cols[at:at + PAIRS_AT_ONCE])

    def merge(self, c: Rows, rows: np.ndarray, cols: np.ndarray) -> None:
        score = (self.q.x[rows] * c.x[cols]).sum(axis=1)
        ids = c.ids[cols]
        use = (score >= self.floor[rows]) & (ids != self.q.ids[rows])
        for r, s, i in zip(rows[use].tolist(), score[use].tolist(), ids[use].tolist()):
            heap = self.heaps[r]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -i))
            elif (s, -i) > heap[0]:
                heapq.heapreplace(heap, (s, -i))
            if len(heap) == self.k:
                self.floor[r] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int, float]]:
        for query, heap in zip(self.q.ids.tolist(), self.heaps):
            for s, i in heap:
                yield query, -i, s


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", query_step: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by `query_step` the k rows with the largest
    inner product, computed in doubles on the original vectors; ties go to the smaller id. The answer is exact.

    Queries are dealt into blocks of about QUERY_BLOCK rows and candidates into strips; a tile is one query block
    against one strip. A task holds one query block and reads the strip batch by batch, so its memory does not depend
    on the table. The int8 product of a batch gives every inner product up to a bound,
    |<x,y> - <x',y'>| <= |x-x'||y| + |x'||y-y'|; pairs whose upper end lies below the k-th best lower end, or below the
    k-th exact score found so far, are out, the rest are recomputed. There are as few strips as fill the cluster, so
    each query leaves k rows per strip for the last merge.

    Vectors that are NULL, empty, zero, or hold NULL or non-finite components take no part; vectors of different length
    are never compared. Repeated rows of one id are separate candidates, but one query (the smallest vector); rows with
    the query's own id are not its candidates. Ids must be whole numbers; rows with a NULL id are left out. Other columns
    are not read.
    """
    rows = coded(vectors, id_col, vec_col)
    asked = rows.filter(F.col("id") % query_step == 0).groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "id"]), "vec").alias("r"))
    asked = asked.select("id", "r.*")
    n_queries, n = asked.count(), rows.count()
    blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    fill = math.ceil(vectors.sparkSession.sparkContext.defaultParallelism / blocks)
    strips = max(1, min(fill, math.ceil(n / TILE_ROWS)))
    sides = (asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
             .withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))).withColumn("side", F.lit(0)))
    sides = sides.unionByName(
        rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("strip", F.pmod(F.xxhash64("id", "vec"), F.lit(strips)).cast("int")).withColumn("side", F.lit(1)))
    dealt = sides.repartition(blocks * strips, "dim", "block", "strip").sortWithinPartitions("dim", "block", "strip", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, best = None, [], None

        def out(found: Best | None) -> Iterator[pa.RecordBatch]:
            if found is not None and (rows := list(found.rows())):
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())],
                                                 ["query_id", "vec_id", "score"])

        for batch in batches:
            for at in range(0, batch.num_rows, TILE_ROWS):
                rest = batch.slice(at, TILE_ROWS)
                keys = np.stack([rest.column(c).to_numpy() for c in ("dim", "block", "strip", "side")])
                cuts = [0, *(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1).tolist(), rest.num_rows]
                for a, b in zip(cuts, cuts[1:]):
                    part, (dim, *tile, side) = rest.slice(a, b - a), keys[:, a].tolist()
                    if (dim, *tile) != key:
                        yield from out(best)
                        key, waiting, best = (dim, *tile), [], None
                    if side == 0:
                        waiting.append(part)
                    elif waiting or best is not None:
                        if best is None:
                            table = pa.Table.from_batches(waiting).combine_chunks()
                            best, waiting = Best(Rows(table.to_batches()[0], dim), k), []
                        best.tile(Rows(part, dim))
        yield from out(best)

    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
