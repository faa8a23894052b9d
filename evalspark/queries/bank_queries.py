"""Feature banks over the embedding view."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import bank as N
from evalspark.operators.curate import content_digest
from evalspark.queries.metrics_queries import rounded
from evalspark.queries.oracle import U, normal, sql
from evalspark.sources import views as V

Q = {}
vec = V.vector
MOM = "SELECT item_id, region, channel, avg(value) AS mean, stddev_pop(value) AS sd, count(*) AS n FROM vector GROUP BY ALL"
MIN_N = 8  # values per region and channel in the view


def q(name, fn, body=None, **kw):
    Q[name] = (fn, sql(body, **{"mom": MOM, **kw}) if body else None)


def ragged(s, d):
    """Regions of different sizes: values above a cut are left out."""
    return vec(s, d).filter(F.col("value") < 0.1)


RAG = "SELECT * FROM vector WHERE value < 0.1::DOUBLE"
q("n01_region_moments", lambda s, d: rounded(N.region_moments(vec(s, d))),
  "SELECT item_id, region, channel, round(mean, 6) AS mean, round(sd, 6) AS sd, n FROM mom")
q("n02_moments_with_fallback", lambda s, d: rounded(N.moments_with_fallback(ragged(s, d), 6)),
  """SELECT item_id, channel, region, round(CASE WHEN n < 6 THEN m0 ELSE m END, 6) AS mean, round(CASE WHEN n < 6 THEN s0 ELSE s END, 6) AS sd, n FROM (SELECT item_id,
 channel, region, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM rag GROUP BY ALL) JOIN (SELECT item_id, channel, avg(value) AS m0, stddev_pop(value) AS s0
 FROM rag GROUP BY ALL) USING (item_id, channel)""", rag=RAG)
q("n03_group_otsu", lambda s, d: rounded(N.group_otsu(vec(s, d), ["item_id"]), keep=("threshold",)),
  """SELECT item_id, arg_max(value, (b, -value)) AS threshold, round(max(b), 6) AS between FROM (SELECT item_id, value, round((k / n) * (1 - k / n) * pow(s / k - (t - s) / (n - k), 2), 12) AS b
 FROM (SELECT item_id, value, sum(c) OVER w AS k, sum(c * value) OVER w AS s, sum(c) OVER (PARTITION BY item_id) AS n, sum(c * value) OVER (PARTITION BY item_id) AS t FROM
 (SELECT item_id, value, count(*) AS c FROM vector GROUP BY ALL) WINDOW w AS (PARTITION BY item_id ORDER BY value)) WHERE k < n) GROUP BY ALL""")


def reference(s, d):
    return N.region_moments(vec(s, d).filter("label = 0"), ["region", "channel"]).select(
        "region", "channel", F.col("mean").alias("ref_mean"), F.col("sd").alias("ref_sd"))


REF = "SELECT region, channel, avg(value) AS ref_mean, stddev_pop(value) AS ref_sd FROM vector WHERE label = 0 GROUP BY ALL"
q("n04_moment_match", lambda s, d: rounded(N.moment_match(vec(s, d), reference(s, d)).select("item_id", "pos", "matched")),
  """SELECT item_id, pos, round((value - mean) * least(ref_sd / greatest(sd, 1e-3::DOUBLE), 3.0::DOUBLE) + ref_mean, 6) AS matched FROM vector JOIN mom USING (item_id, region, channel)
 JOIN refm USING (region, channel)""", refm=REF)
FIT = """SELECT channel, avg(m) AS mean_avg, stddev_pop(m) AS mean_std, avg(s) AS sd_avg, stddev_pop(s) AS sd_std, count(*) AS items FROM (SELECT item_id, channel, avg(value) AS m,
 stddev_pop(value) AS s FROM vector GROUP BY ALL) GROUP BY ALL"""
q("n05_template_fit", lambda s, d: rounded(N.template_fit(vec(s, d))),
  "SELECT channel, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean_avg", "mean_std", "sd_avg", "sd_std")) + ", items FROM fit", fit=FIT)
q("n06_template_augment", lambda s, d: rounded(N.template_augment(vec(s, d), N.template_fit(vec(s, d)), 0.5, 11).select("item_id", "pos", "augmented")),
  f"""SELECT item_id, pos, round(CASE WHEN {U("item_id", "11", "'pick'")} < 0.5::DOUBLE THEN (value - m) * (greatest(sd_avg + sd_std * {normal("item_id", "channel", "11", "'sd'")},
 1e-3::DOUBLE) / greatest(s, 1e-3::DOUBLE)) + (mean_avg + mean_std * {normal("item_id", "channel", "11", "'mean'")}) ELSE value END, 6) AS augmented FROM vector JOIN
 (SELECT item_id, channel, avg(value) AS m, stddev_pop(value) AS s FROM vector GROUP BY ALL) USING (item_id, channel) JOIN fit USING (channel)""", fit=FIT)


def transfer(s, d):
    bank = N.region_moments(vec(s, d).filter("label < 5"))
    t = N.bank_transfer(vec(s, d), bank, 0.5, 0.3, 0.9, 13, F.col("item_id") % 10 == 0)
    return rounded(t.select("item_id", "pos", "row_id", "selected", "transferred"))


q("n07_bank_transfer", transfer,
  f"""SELECT item_id, pos, row_id, selected, round(CASE WHEN selected THEN value + a * ((value - mean) * least(ref_sd / greatest(sd, 1e-3::DOUBLE), 3.0::DOUBLE) + ref_mean - value)
 ELSE value END, 6) AS transferred FROM (SELECT v.*, mean, sd, {U("item_id", "13", "'pick'")} < 0.5::DOUBLE AND item_id % 10 <> 0 AS selected,
 0.3::DOUBLE + (0.9::DOUBLE - 0.3::DOUBLE) * {U("item_id", "13", "'blend'")} AS a,
 least(floor({U("item_id", "13", "'row'")} * (SELECT count(*) FROM brow))::BIGINT, (SELECT count(*) FROM brow) - 1) AS idx FROM vector v JOIN mom USING (item_id, region, channel))
 JOIN brow USING (idx) JOIN (SELECT item_id AS row_id, region, channel, mean AS ref_mean, sd AS ref_sd FROM mom) USING (row_id, region, channel)""",
  brow="SELECT DISTINCT item_id AS row_id, dense_rank() OVER (ORDER BY item_id) - 1 AS idx FROM vector WHERE label < 5")
ROB = """SELECT item_id, bool_and((v - md) / (1.4826::DOUBLE * mad) <= 1.5::DOUBLE) AS keep FROM (SELECT *, quantile_cont(abs(v - md), 0.5) OVER (PARTITION BY region, channel) AS mad FROM (
 SELECT item_id, region, channel, ln(sd) AS v, quantile_cont(ln(sd), 0.5) OVER (PARTITION BY region, channel) AS md FROM mom)) GROUP BY ALL"""
q("n08_robust_filter", lambda s, d: N.robust_filter(N.region_moments(vec(s, d)), 1.5), "SELECT item_id, keep FROM rob", rob=ROB)
q("n09_build_bank", lambda s, d: rounded(N.build_bank(vec(s, d), MIN_N, 1.5)[0]),
  "SELECT item_id, region, channel, round(mean, 6) AS mean, round(sd, 6) AS sd, n FROM mom JOIN rob USING (item_id) WHERE keep", rob=ROB)


def provenance(s, d):
    """The counts, and the digest against one taken over the bank as it was returned."""
    bank, p = N.build_bank(vec(s, d), MIN_N, 1.5)
    grey = bank.select("item_id", "region", "channel", *[F.round(c, 9).alias(c) for c in ("mean", "sd")])
    same = content_digest(grey, ["item_id", "region", "channel", "mean", "sd"]).select("rows", F.col("digest").alias("again"))
    return p.crossJoin(same).select("n_valid", "n_dropped", "rows", (F.col("digest") == F.col("again")).alias("digest_holds"),
                                    F.length("digest").alias("digits"))


q("n09_bank_provenance", provenance,
  """SELECT count(*) FILTER (keep) AS n_valid, count(*) FILTER (NOT keep) AS n_dropped, (SELECT count(*) FROM mom JOIN rob USING (item_id) WHERE keep) AS rows,
 TRUE AS digest_holds, 64 AS digits FROM rob""", rob=ROB)


def wide(s, d):
    return N.bank_vectors(N.region_moments(vec(s, d)), ["a", "b"], [0, 1, 2, 3])


COLS = [f"{p}_{r}{c}" for p in "ms" for r in "ab" for c in range(4)]
MEANS = COLS[:8]
q("n10_shrunk_cov", lambda s, d: rounded(N.covariance_table(wide(s, d), COLS)))
q("n10_virtual_rows", lambda s, d: rounded(N.virtual_rows(wide(s, d), COLS, 1000, 17, COLS[8:])))
q("n11_diverse_sample", lambda s, d: rounded(N.diverse_sample(wide(s, d), MEANS, 10, 0)))
q("n12_axis_references", lambda s, d: N.axis_references(wide(s, d), MEANS, 5.0))
