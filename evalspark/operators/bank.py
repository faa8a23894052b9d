"""Feature banks: region moments, moment matching, robust rejection, shrunk covariance, diverse references."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import draw_index, normal, uniform
from evalspark.operators.curate import content_digest
from evalspark.plans.groups import join_skewed, rank_rows
from evalspark.plans.lineage import cut_lineage
from evalspark.plans.prefix import exact_quantiles, running_totals

# fixed bank values
MIN_REGION, SD_FLOOR, MAX_SCALE, Z_MAX, MAD = 64, 1e-3, 3.0, 4.0, 1.4826


def region_moments(V: DataFrame, by: Sequence[str] = ("item_id", "region", "channel"), value: str = "value") -> DataFrame:
    """Mean, population sd and count per item, region and channel."""
    return V.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))


def moments_with_fallback(V: DataFrame, min_n: int = MIN_REGION, item: Sequence[str] = ("item_id", "channel"),
                          region: str = "region") -> DataFrame:
    """Region moments; a region with fewer than min_n values takes the moments of the whole item."""
    whole = region_moments(V, item).select(*item, F.col("mean").alias("m0"), F.col("sd").alias("s0"))
    small = F.col("n") < min_n
    return region_moments(V, [*item, region]).join(whole, list(item)).select(
        *item, region, F.when(small, F.col("m0")).otherwise(F.col("mean")).alias("mean"),
        F.when(small, F.col("s0")).otherwise(F.col("sd")).alias("sd"), "n")


def group_otsu(V: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Exact split per group that maximises the between-class variance, only between distinct values; the lowest
    threshold on ties. The class above is value > threshold."""
    h = V.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    h = h.withColumn("sv", F.col("c") * F.col(value))
    t = running_totals(h, by, value, ["c", "sv"])
    k, n = F.col("c_before") + F.col("c"), F.col("c_total")
    s = F.col("sv_before") + F.col("sv")
    w0 = k / n
    gap = s / k - (F.col("sv_total") - s) / F.greatest(n - k, F.lit(1))
    b = F.when(k < n, w0 * (1.0 - w0) * gap * gap)
    t = t.withColumn("between", F.round(b, 12))
    best = t.filter(F.col("between").isNotNull()).groupBy(*by).agg(
        F.max(F.struct(F.col("between"), (-F.col(value)).alias("m"))).alias("b"))
    return best.select(*by, (-F.col("b.m")).alias("threshold"), F.col("b.between").alias("between"))


def matched(x: Column, mean: Column, sd: Column, ref_mean: Column, ref_sd: Column, floor: float = SD_FLOOR,
            cap: float | None = MAX_SCALE) -> Column:
    scale = ref_sd / F.greatest(sd, F.lit(floor))
    scale = scale if cap is None else F.least(scale, F.lit(cap))
    return (x - mean) * scale + ref_mean


def moment_match(V: DataFrame, reference: DataFrame, keys: Sequence[str] = ("item_id", "region", "channel"),
                 ref_keys: Sequence[str] = ("region", "channel"), floor: float = SD_FLOOR, cap: float = MAX_SCALE,
                 value: str = "value") -> DataFrame:
    """Values moved to the reference moments, the stretch capped. `reference` holds ref_keys, ref_mean, ref_sd."""
    m = region_moments(V, keys, value).join(reference, list(ref_keys))
    d = join_skewed(V, m, list(keys), "n")
    return d.withColumn("matched", matched(F.col(value), F.col("mean"), F.col("sd"), F.col("ref_mean"), F.col("ref_sd"),
                                           floor, cap)).drop("mean", "sd", "ref_mean", "ref_sd")


def template_fit(V: DataFrame, item: Sequence[str] = ("item_id", "channel"), channel: Sequence[str] = ("channel",)) -> DataFrame:
    """Distribution of the per-item mean and sd over items: mean and population sd of each."""
    m = region_moments(V, item)
    return m.groupBy(*channel).agg(F.avg("mean").alias("mean_avg"), F.stddev_pop("mean").alias("mean_std"),
                                   F.avg("sd").alias("sd_avg"), F.stddev_pop("sd").alias("sd_std"),
                                   F.count(F.lit(1)).alias("items"))


def template_augment(V: DataFrame, fit: DataFrame, prob: float, seed: int, spread: float = 0.0, floor: float = SD_FLOOR) -> DataFrame:
    """Each selected item is matched to its own drawn template (mean and sd per channel); others stay."""
    item, ch = "item_id", "channel"
    m = region_moments(V, [item, ch]).join(fit.drop("items"), ch)
    m = m.withColumns({
        "selected": uniform(item, F.lit(seed), F.lit("pick")) < prob,
        "ref_mean": F.col("mean_avg") + F.col("mean_std") * (1.0 + spread) * normal(item, ch, F.lit(seed), F.lit("mean")),
        "ref_sd": F.greatest(F.col("sd_avg") + F.col("sd_std") * (1.0 + spread) * normal(item, ch, F.lit(seed), F.lit("sd")),
                             F.lit(floor))})
    m = m.select(item, ch, "n", "mean", "sd", "selected", "ref_mean", "ref_sd")
    d = join_skewed(V, m, [item, ch], "n")
    new = matched(F.col("value"), F.col("mean"), F.col("sd"), F.col("ref_mean"), F.col("ref_sd"), floor, None)
    return d.withColumn("augmented", F.when(F.col("selected"), new).otherwise(F.col("value"))).drop(
        "mean", "sd", "ref_mean", "ref_sd")


def bank_rows(bank: DataFrame, item: str = "item_id") -> DataFrame:
    """Bank items with a row index 0..n-1 and n."""
    r = rank_rows(bank.select(F.col(item).alias("row_id")).distinct(), [], ["row_id"], "idx").withColumn("idx", F.col("idx") - 1)
    return r.withColumn("n", bank.select(item).distinct().agg(F.count(F.lit(1)).alias("n")).select("n").scalar())


def bank_transfer(V: DataFrame, bank: DataFrame, prob: float, lo: float, hi: float, seed: int,
                  exclude: Column | None = None) -> DataFrame:
    """Each selected item moves a share a ~ U[lo, hi] of the way to the moments of a random bank row."""
    item, keys = "item_id", ["region", "channel"]
    rows = bank_rows(bank)
    total = bank.select(item).distinct().agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    pick = uniform(item, F.lit(seed), F.lit("pick")) < prob
    if exclude is not None:
        pick = pick & ~exclude
    own = region_moments(V, [item, *keys])
    own = own.withColumns({"selected": pick, "a": lo + (hi - lo) * uniform(item, F.lit(seed), F.lit("blend")),
                           "idx": draw_index(total, item, F.lit(seed), F.lit("row"))})
    ref = bank.select(F.col(item).alias("row_id"), *keys, F.col("mean").alias("ref_mean"), F.col("sd").alias("ref_sd"))
    own = own.join(rows.select("idx", "row_id"), "idx").join(ref, ["row_id", *keys])
    d = join_skewed(V, own.drop("idx"), [item, *keys], "n")
    x = F.col("value")
    new = x + F.col("a") * (matched(x, F.col("mean"), F.col("sd"), F.col("ref_mean"), F.col("ref_sd")) - x)
    return d.withColumn("transferred", F.when(F.col("selected"), new).otherwise(x)).drop("mean", "sd", "ref_mean", "ref_sd", "a")


def robust_filter(bank: DataFrame, z: float = Z_MAX, dims: Sequence[str] = ("region", "channel"), item: str = "item_id") -> DataFrame:
    """Items none of whose log sds lies more than z robust sds (1.4826 MAD) above its median."""
    d = bank.select(item, *dims, F.log("sd").alias("v"))
    med = exact_quantiles(d, dims, "v", {"median": 0.5})
    dev = d.join(med, list(dims)).withColumn("dev", F.abs(F.col("v") - F.col("median")))
    mad = exact_quantiles(dev, dims, "dev", {"mad": 0.5})
    ok = (F.col("v") - F.col("median")) / (F.lit(MAD) * F.col("mad")) <= z
    return dev.join(mad, list(dims)).groupBy(item).agg(F.bool_and(ok).alias("keep"))


def build_bank(V: DataFrame, min_n: int = MIN_REGION, z: float = Z_MAX) -> tuple[DataFrame, DataFrame]:
    """(bank, provenance): moments of items whose regions are all large enough and finite, after robust rejection, with
    counts and the content digest."""
    m = region_moments(V)
    ok = (F.col("n") >= min_n) & (F.col("sd") > 0) & F.col("mean").isNotNull()
    valid = m.groupBy("item_id").agg(F.bool_and(ok).alias("ok")).filter("ok").select("item_id")
    m = cut_lineage(m.join(valid, "item_id"))
    keep = robust_filter(m, z)
    bank = cut_lineage(m.join(keep.filter("keep").select("item_id"), "item_id"))
    n = keep.agg(F.count(F.when(F.col("keep"), 1)).alias("n_valid"), F.count(F.when(~F.col("keep"), 1)).alias("n_dropped"))
    grey = bank.select("item_id", "region", "channel", *[F.round(c, 9).alias(c) for c in ("mean", "sd")])
    digest = content_digest(grey, ["item_id", "region", "channel", "mean", "sd"])
    return bank, n.withColumn("digest", digest.select("digest").scalar())


def bank_vectors(bank: DataFrame, regions: Sequence[str], channels: Sequence[int]) -> DataFrame:
    """One wide row per item: means and log sds."""
    cells = [(r, c) for r in regions for c in channels]
    def at(r, c, v):
        return F.max(F.when((F.col("region") == r) & (F.col("channel") == c), v))
    return bank.groupBy("item_id").agg(*[at(r, c, F.col("mean")).alias(f"m_{r}{c}") for r, c in cells],
                                       *[at(r, c, F.log(F.greatest("sd", F.lit(1e-3)))).alias(f"s_{r}{c}") for r, c in cells])


def _moments(B: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Mean, centred second moments, rows and the sum of fourth powers of the centred norm: d + d(d+1)/2 numbers."""
    first = B.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols]).first()
    n, mu = first[0], np.array(first[1:], dtype=float)
    x = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, mu)]
    norm = sum((v * v for v in x[1:]), x[0] * x[0])
    k = len(cols)
    r = B.agg(F.sum(norm * norm), *[F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k)]).first()
    s = np.zeros((k, k))
    s[np.triu_indices(k)] = r[1:]
    return mu, s + np.triu(s, 1).T, n, float(r[0])


def shrunk_cov(B: DataFrame, cols: Sequence[str]) -> dict:
    """Ledoit-Wolf mean, covariance, shrinkage and Cholesky factor of the rows."""
    mu, s, n, fourth = _moments(B, cols)
    p, emp = len(cols), s / n
    target = np.trace(emp) / p
    distance = ((emp ** 2).sum() - p * target ** 2) / p
    noise = min((fourth / n - (emp ** 2).sum()) / (n * p), distance)
    shrink = 0.0 if noise <= 0 or distance <= 0 else noise / distance
    cov = (1.0 - shrink) * emp + shrink * target * np.eye(p)
    return {"mean": mu, "covariance": cov, "shrinkage": shrink, "cholesky": np.linalg.cholesky(cov)}


def covariance_table(B: DataFrame, cols: Sequence[str]) -> DataFrame:
    f = shrunk_cov(B, cols)
    rows = [(a, b, float(f["covariance"][i, j]), float(f["shrinkage"])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return B.sparkSession.createDataFrame(rows, "a string, b string, covariance double, shrinkage double")


def virtual_rows(B: DataFrame, cols: Sequence[str], n: int, seed: int, log_cols: Sequence[str] = ()) -> DataFrame:
    """n rows drawn from the shrunk Gaussian of the bank; log columns come back as their exponential."""
    f = shrunk_cov(B, cols)
    rows = B.sparkSession.range(n).select(F.col("id").alias("row"))
    rows = rows.withColumns({f"__z{j}": normal("row", F.lit(seed), F.lit(j)) for j in range(len(cols))})
    out = []
    for i, c in enumerate(cols):
        v = F.lit(float(f["mean"][i]))
        for j in range(i + 1):
            v = v + F.lit(float(f["cholesky"][i, j])) * F.col(f"__z{j}")
        out.append((F.exp(v) if c in log_cols else v).alias(c))
    return rows.select("row", *out)


def _squared_distance(cols: Sequence[str], point: Sequence[float]) -> Column:
    terms = [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(cols, point)]
    return sum(terms[1:], terms[0])


def diverse_sample(B: DataFrame, cols: Sequence[str], k: int, start, item: str = "item_id", cut_every: int = 8) -> DataFrame:
    """k rows by farthest-point sampling from `start`: one aggregate per pick, only the picked row reaches the driver."""
    d = B.select(item, *cols)
    pick = d.filter(F.col(item) == start).first()
    order = [(0, pick[0], 0.0)]
    d = d.withColumn("__d", _squared_distance(cols, list(pick)[1:]))
    for i in range(1, k):
        if i % cut_every == 0:
            d = cut_lineage(d)
        best = d.agg(F.max(F.struct(F.round("__d", 12).alias("d"), (-F.col(item)).alias("m"), *cols)).alias("b")).first()[0]
        order.append((i, -best["m"], float(np.sqrt(best["d"]))))
        d = d.withColumn("__d", F.least("__d", _squared_distance(cols, list(best)[2:])))
    return B.sparkSession.createDataFrame(order, "position int, item_id bigint, distance double")


def axis_references(B: DataFrame, cols: Sequence[str], q: float, item: str = "item_id") -> DataFrame:
    """Rows nearest both tail percentiles of the first two principal axes. An axis points to its largest loading."""
    mu, s, n, _ = _moments(B, cols)
    _, vec = np.linalg.eigh(s / n)
    axes = vec[:, ::-1][:, :2].T
    axes = [a * np.sign(a[np.abs(a).argmax()]) for a in axes]
    def score(a: np.ndarray) -> Column:
        terms = [F.lit(float(w)) * (F.col(c) - F.lit(float(m))) for w, c, m in zip(a, cols, mu)]
        return sum(terms[1:], terms[0])
    d = cut_lineage(B.select(item, score(axes[0]).alias("s1"), score(axes[1]).alias("s2")))
    tails = {}
    for axis in ("s1", "s2"):
        r = exact_quantiles(d, [], axis, {"lo": q / 100.0, "hi": 1.0 - q / 100.0}).first()
        tails[axis] = (r["lo"], r["hi"])
    targets = [("axis 1 low", tails["s1"][0], 0.0), ("axis 1 high", tails["s1"][1], 0.0),
               ("axis 2 low", 0.0, tails["s2"][0]), ("axis 2 high", 0.0, tails["s2"][1])]
    near = [F.min_by(F.col(item), F.struct(F.round(F.hypot(F.col("s1") - F.lit(float(a)), F.col("s2") - F.lit(float(b))), 12), F.col(item)))
            .alias(f"t{i}") for i, (_, a, b) in enumerate(targets)]
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("target"), F.col(f"t{i}").alias(item))
                                for i, (name, *_) in enumerate(targets)]))
    return d.agg(*near).select(cells.alias("c")).select("c.*")
