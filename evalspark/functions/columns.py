"""Column expressions shared by the operators. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SCALE = float(2**52)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_int(*parts) -> Column:
    """A 52-bit integer from the md5 of the parts joined by ':'; the same on every run and partitioning."""
    text = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """A reproducible uniform number in [0, 1) keyed by the given columns."""
    return hash_int(*parts).cast("double") / F.lit(HASH_SCALE)


def normal(*parts) -> Column:
    """A reproducible standard normal number (Box-Muller on two hashed uniforms)."""
    u1, u2 = uniform(*parts, F.lit("a")), uniform(*parts, F.lit("b"))
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(6.283185307179586) * u2)


def draw_index(n, *parts) -> Column:
    """A reproducible integer in 0..n-1."""
    return F.least(F.floor(uniform(*parts) * col(n)).cast("bigint"), (col(n) - 1).cast("bigint"))


def nan_to_null(c) -> Column:
    """NaN is the reference null; Spark orders it above every number, so it becomes NULL at the source."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def finite(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def clip(c, lo: float, hi: float) -> Column:
    """least/greatest skip NULL, which would turn a missing score into a bound; keep it NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def logit(p, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


def ratio(a, b) -> Column:
    """a / b as a double, NULL when b is 0."""
    a, b = col(a), col(b)
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def round6(c) -> Column:
    return F.round(col(c), 6)


def bin_edges(bins: int) -> list[float]:
    step = 1.0 / bins
    return [k * step for k in range(1, bins)]


def score_bin(p, bins: int = 10) -> Column:
    """Equal-width bin of a probability: the number of inner edges at or below it."""
    p = col(p)
    return reduce(lambda a, b: a + b, [(p >= F.lit(e)).cast("int") for e in bin_edges(bins)])


def overlap_1d(a0, a1, b0, b1) -> Column:
    return F.greatest(F.lit(0.0), F.least(col(a1), col(b1)) - F.greatest(col(a0), col(b0)))


def box_intersection(a, b) -> Column:
    """Intersection area of two boxes given as (x, y, w, h) column tuples."""
    ax, ay, aw, ah = map(col, a)
    bx, by, bw, bh = map(col, b)
    return overlap_1d(ax, ax + aw, bx, bx + bw) * overlap_1d(ay, ay + ah, by, by + bh)


def iou(a, b) -> Column:
    inter = box_intersection(a, b)
    return inter / (col(a[2]) * col(a[3]) + col(b[2]) * col(b[3]) - inter)


def hamming(a, b) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))
