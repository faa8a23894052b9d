"""Small linear fits over large tables: all models at once, one aggregate of moments per pass, and the k x k algebra of every
group where its moments lie. The models are a table; nothing of them passes through the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import sigmoid
from evalspark.plans.lineage import stored


def linear(beta: Column, cols: Sequence[str]) -> Column:
    """Intercept plus weighted columns; beta is an array column, intercept first."""
    out = beta[0]
    for i, c in enumerate(cols):
        out = out + beta[i + 1] * F.col(c)
    return out


def _design(cols: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(c) for c in cols]]


def _square(values: Sequence[float], k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = values
    return m + np.triu(m, 1).T


def _moments(weight: Column, target: Column, x: Sequence[Column]) -> Column:
    """Upper triangle of sum(weight x x') and then sum(target x), as one array."""
    k = len(x)
    return F.array(*[F.sum(weight * x[a] * x[b]) for a in range(k) for b in range(a, k)], *[F.sum(target * v) for v in x]).alias("__m")


def _solved(moments: DataFrame, keys: Sequence[str], solve) -> DataFrame:
    """One row per row of `moments` (keys, __m, ...): solve(row) gives beta and whether the model still moves."""
    keys, kinds = list(keys), dict(moments.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [solve(r) for r in batch.select([c for c in batch.schema.names if c not in keys]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array([d[0].tolist() for d in done], pa.list_(pa.float64())),
                                              pa.array([bool(d[1]) for d in done])], [*keys, "beta", "moving"])

    return moments.mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keys) + "beta array<double>, moving boolean")


def least_squares(df: DataFrame, by: Sequence[str], cols: Sequence[str], target: str) -> DataFrame:
    """(by, beta): ordinary least squares with an intercept for every group, from cross moments."""
    k = len(cols) + 1

    def solve(row: dict) -> tuple[np.ndarray, bool]:
        m = np.array(row["__m"], dtype=float)
        return np.linalg.lstsq(_square(m[:-k], k), m[-k:], rcond=None)[0], False

    moments = df.groupBy(*by).agg(_moments(F.lit(1.0), F.col(target), _design(cols)))
    return _solved(moments, by, solve).drop("moving")


def logistic(df: DataFrame, by: Sequence[str], cols: Sequence[str], y: str = "y", c: float | str = 1.0, weight: str | None = None,
             iters: int = 50, tol: float = 1e-8, fold: str | None = None, folds: int = 0) -> DataFrame:
    """(by, beta): L2-penalised logistic regression (penalty |w|^2 / 2C, intercept free) of every group by Newton steps; C is
    a number or a column that is constant in a group. With `fold`, (by, model, beta) for models 0..folds - 1, each fitted to
    the rows of all other folds: rows meet the models of their group in the pass itself and are never stored per model.

    All models share each pass; a converged model leaves the next one. A fit that has not converged after `iters` passes
    is an error.
    """
    by, k = [*by, "__all"], len(cols) + 1
    keys = [*by, "model"] if fold else by
    d = df.withColumns({"__all": F.lit(0), "__c": F.lit(float(c)) if not isinstance(c, str) else F.col(c).cast("double")}).persist()
    models = d.groupBy(*by).agg(F.max("__c").alias("__c"))
    if fold:
        models = models.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    state = stored(models.withColumns({"beta": F.array_repeat(F.lit(0.0), k), "moving": F.lit(True)}))
    x = _design(cols)
    w = F.lit(1.0) if weight is None else F.col(weight)

    def solve(row: dict) -> tuple[np.ndarray, bool]:
        m, beta = np.array(row["__m"], dtype=float), np.array(row["beta"], dtype=float)
        ridge = np.diag([0.0] + [1.0 / row["__ridge"]] * (k - 1))
        step = np.linalg.solve(_square(m[:-k], k) + ridge + 1e-12 * np.eye(k), m[-k:] + ridge @ beta)
        return beta - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12)), np.abs(step).max() >= tol

    for _ in range(iters):
        j = d.drop("__c").join(state.filter("moving").drop("moving"), by)
        if fold:
            j = j.filter(F.col(fold) != F.col("model"))
        j = j.withColumn("__p", sigmoid(linear(F.col("beta"), cols)))
        moments = j.groupBy(*keys).agg(_moments(w * F.col("__p") * (1.0 - F.col("__p")), w * (F.col("__p") - F.col(y)), x),
                                       F.first("beta").alias("beta"), F.first("__c").alias("__ridge"), F.first("__c").alias("__c"))
        new = _solved(moments, [*keys, "__c"], solve)
        state = stored(state.filter("NOT moving").unionByName(new))
        if state.filter("moving").isEmpty():
            break
    else:
        n = state.filter("moving").count()
        raise RuntimeError(f"{n} fits did not converge in {iters} steps")
    d.unpersist()
    return state.select(*[c for c in keys if c != "__all"], "beta")
