"""Running totals, areas and exact quantiles over ordered numbers.

A window ordered by score would put a whole run in one task. Scores are first reduced to one row per distinct value
and then split by a monotone code of the number (binary exponent and leading mantissa bits, then the next 21 bits), so
that no window partition can hold more than about two million rows whatever the distribution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.columns import col

HI, LO = "__hi", "__lo"


def order_code(x) -> tuple[Column, Column]:
    """Two integers whose lexicographic order agrees with the order of the finite number x (equal x, equal code)."""
    x = col(x).cast("double")
    mag, sign = F.abs(x), F.signum(x)
    exponent = F.greatest(F.floor(F.log2(mag)), F.lit(-1000)).cast("double")
    scaled = mag * F.pow(F.lit(2.0), -exponent) * F.lit(1024.0)
    lead = F.floor(scaled)
    hi = F.when(mag == 0, F.lit(0.0)).otherwise(sign * ((exponent + 1001) * 4096 + lead))
    lo = F.when(mag == 0, F.lit(0.0)).otherwise(sign * F.floor((scaled - lead) * F.lit(2097152.0)))
    return hi.cast("bigint"), lo.cast("bigint")


def with_code(df: DataFrame, x: str) -> DataFrame:
    # never NULL, so that no join on the code makes the optimizer push an inlined null test of it down to the scan
    hi, lo = (F.coalesce(c, F.lit(-(2**62))) for c in order_code(x))
    return df.withColumns({HI: hi, LO: lo})


def _before(keys: Sequence[str], order: str, value: str, descending: bool) -> Column:
    o = F.col(order).desc() if descending else F.col(order).asc()
    w = Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def running_totals(df: DataFrame, by: Sequence[str], x: str, sums: Sequence[str],
                   descending: bool = False) -> DataFrame:
    """For one row per (group, x): the sum of each column over smaller x (larger when descending) as `<c>_before`,
    and over the whole group as `<c>_total`."""
    by = list(by)
    rows = with_code(df, x)
    low = rows.groupBy(*by, HI, LO).agg(*[F.sum(c).alias(c) for c in sums])
    top = low.groupBy(*by, HI).agg(*[F.sum(c).alias(c) for c in sums])
    top = top.select(*by, HI,
                     *[_before(by, HI, c, descending).alias(f"__t_{c}") for c in sums],
                     *[F.sum(c).over(Window.partitionBy(*by)).alias(f"{c}_total") for c in sums])
    low = low.select(*by, HI, LO, *[_before([*by, HI], LO, c, descending).alias(f"__l_{c}") for c in sums])
    offsets = low.join(top, [*by, HI])
    rows = rows.select("*", *[_before([*by, HI, LO], x, c, descending).alias(f"__r_{c}") for c in sums])
    out = rows.join(offsets, [*by, HI, LO])
    return out.select(*df.columns,
                      *[(F.col(f"__r_{c}") + F.col(f"__l_{c}") + F.col(f"__t_{c}")).alias(f"{c}_before") for c in sums],
                      *[f"{c}_total" for c in sums])


def mann_whitney(hist: DataFrame, by: Sequence[str], x: str, keep: Sequence[str] = ()) -> DataFrame:
    """Per group: pos, neg and 2U = sum pos * (2 * neg below + neg tied), folded upwards through the code levels.

    `hist` holds one row per (group, x) with pos and neg; `keep` columns are summed along. The fold needs no join:
    each level adds pos * 2 * neg of the earlier siblings to what its children already counted.
    """
    by = list(by)
    d = with_code(hist, x).withColumn(
        "__u", F.col("pos").cast("double") * (2.0 * _before([*by, HI, LO], x, "neg", False) + F.col("neg")))

    def up(t: DataFrame, keys: list[str]) -> DataFrame:
        return t.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "__u", *keep)])

    d = up(d, [*by, HI, LO])
    for keys, order in (([*by, HI], LO), (by, HI)):
        d = d.withColumn("__u", F.col("__u") + F.col("pos").cast("double") * 2.0 * _before(keys, order, "neg", False))
        d = up(d, keys)
    return d.withColumnRenamed("__u", "two_u")


def exact_quantiles(df: DataFrame, by: Sequence[str], x: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group: ranks come from running counts over the distinct values."""
    by = list(by)
    hist = df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("__c"))
    t = running_totals(hist, by, x, ["__c"])
    aggs, outs = [], []
    for name, q in quantiles.items():
        place = F.lit(float(q)) * (F.col("__c_total") - 1)
        for part, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = (F.col("__c_before") <= rank) & (rank < F.col("__c_before") + F.col("__c"))
            aggs.append(F.max(F.when(hit, F.col(x))).alias(f"__{name}_{part}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"__{name}_f"))
        outs.append((F.col(f"__{name}_lo") + (F.col(f"__{name}_hi") - F.col(f"__{name}_lo")) * F.col(f"__{name}_f"))
                    .alias(name))
    return t.groupBy(*by).agg(*aggs).select(*by, *outs)
