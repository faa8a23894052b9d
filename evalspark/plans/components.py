"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.plans.groups import join_skewed
from evalspark.plans.lineage import stored


def _star(e: DataFrame) -> DataFrame:
    """Every edge (u, v) with the smallest member m of the neighbourhood of u; hubs are split over tasks. `e` should be
    stored, or a plain projection of stored rows: it is read twice."""
    m = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg"))
    return join_skewed(e, stored(m.withColumn("m", F.least("m", "u")), "least"), ["u"], "deg")


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "a",
                         b: str = "b", out: str = "component", max_rounds: int = 100) -> DataFrame:
    """Smallest node id of the component of every node. The number of rounds grows with the logarithm of the longest
    chain. The smallest members and the edges of each star are written as tables: a checkpoint would keep the size that
    Spark guessed, joins multiply guesses, and after a few rounds the guess alone is a number of very many digits in
    every plan on the driver."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = stored(e, "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(_star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        ends = F.explode(F.array("u", "v")).alias("u")
        e = stored(_star(large).select(ends, F.col("m").alias("v")).filter("u <> v").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    root = e.select(F.col("u").alias(node), F.col("v").alias("__root"))
    return nodes.join(root, node, "left").withColumn(out, F.coalesce("__root", node)).drop("__root")
