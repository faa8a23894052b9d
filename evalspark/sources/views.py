"""Views that shape the driver tables like the inputs of the operators (predictions, boxes, logs, features, ...).

Each view is a pure function of its table: everything random in it is an md5 uniform of row keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.columns import uniform
from evalspark.plans.groups import gather
from evalspark.sources.tables import table

ARM_WEIGHTS = {"blend": 0.7, "full": 0.9, "jitter": 0.6, "plain": 0.5}
SEEDS = (0, 1, 2)
COHORTS = ("val", "testa", "testb")


def grain(x) -> "F.Column":
    """Floor to three decimals, so that scores tie."""
    return F.floor(x * F.lit(1000.0)) / F.lit(1000.0)


def once(x) -> "F.Column":
    """Keep a costly expression from being copied into every filter above it: filters do not move below a generator."""
    return F.explode(F.array(x))


def items(spark: SparkSession, folder: str) -> DataFrame:
    """One row per item: label, cohort, resampling unit (never mixing classes) and subtype."""
    o = table(spark, folder, "orders")
    y = (F.col("o_orderstatus") == "F").cast("int")
    cohort = F.when(F.col("o_orderkey") % 3 == 0, "val").when(F.col("o_orderkey") % 3 == 1, "testa").otherwise("testb")
    return o.select(cohort.alias("cohort"), F.col("o_orderkey").alias("item_id"), y.alias("y"),
                    F.concat(F.col("o_custkey").cast("string"), F.lit("_"), y.cast("string")).alias("unit"),
                    F.when(y == 0, "base").otherwise(F.concat(F.lit("sub"), (F.col("o_custkey") % 3).cast("string")))
                    .alias("subtype"))


def prediction(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(items(spark, folder))


def _scored(items: DataFrame) -> DataFrame:
    """Scores of every run of the items."""
    runs = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(s).alias("seed"), F.lit(w).alias("w"))
                               for a, w in ARM_WEIGHTS.items() for s in SEEDS]))
    d = items.withColumn("run", runs).select("*", "run.*").drop("run")
    d = d.withColumn("k", F.col("w") + F.lit(0.05) * F.col("seed")).withColumn("u", uniform("item_id", "arm", "seed"))
    p = F.lit(0.5) * F.col("k") * F.col("y") + F.col("u") * (F.lit(1.0) - F.lit(0.5) * F.col("k"))
    return d.select("cohort", "arm", "seed", "item_id", "unit", "subtype", "y", once(grain(p)).alias("p"))


def swap_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every run under donor-swap conditions. Items come into place before they are repeated per run and condition, so
    that groups of (run, item) shuffle none of the repeated rows."""
    cond = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(s).alias("s")) for c, s in SWAP.items()]))
    d = _scored(gather(items(spark, folder), ["item_id"])).withColumn("c", cond).select("*", "c.*").drop("c")
    noisy = F.col("p") * (F.lit(1.0) - F.col("s")) + F.col("s") * uniform("item_id", "arm", "seed", "condition")
    return d.withColumn("p", once(grain(noisy))).drop("s")


SWAP = {"original": 0.0, "none": 0.5, "other0": 0.4, "other1": 0.4, "same0": 0.2, "same1": 0.2}


def instance(spark: SparkSession, folder: str) -> DataFrame:
    """Scored instances of an item: position, radius, score and the detector's keep flag."""
    li = table(spark, folder, "lineitem")
    inst = (F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    key = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.select(F.col("l_orderkey").alias("item_id"), inst.alias("inst_id"),
                     F.floor(uniform(*key, F.lit("x")) * 200).cast("double").alias("x"),
                     F.floor(uniform(*key, F.lit("y")) * 200).cast("double").alias("y"),
                     F.col("l_quantity").alias("r"), grain(uniform(*key, F.lit("p"))).alias("p"),
                     (F.col("l_discount") < 0.05).alias("keep"))


def box(spark: SparkSession, folder: str) -> DataFrame:
    """Annotation boxes on the field of a supplier, on a coarse lattice so that overlaps and conflicts occur."""
    li = table(spark, folder, "lineitem")
    key = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ann = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    category = (F.when(F.col("l_returnflag") == "A", "lymph")
                .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "mono")
                .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "none").otherwise("blast"))
    supp = F.col("l_suppkey")
    kind = F.when(supp % 3 == 0, "ALL").when(supp % 3 == 1, "CLL").otherwise("AML")
    name = F.concat((supp % 20).cast("string"), F.lit("_"), supp.cast("string"), F.lit("_1000_"), kind, F.lit(".png"))
    size = [F.when(uniform(*key, F.lit(s + "s")) < 0.02, F.lit(4.0))
            .otherwise(16.0 + 8.0 * F.floor(uniform(*key, F.lit(s)) * 4)) for s in ("w", "h")]
    return li.select(
        F.when(supp % 17 != 0, F.concat(F.lit("fields/"), name)).alias("image_path"), name.alias("file_name"),
        (supp % 20).cast("string").alias("slide"), supp.cast("string").alias("image"), kind.alias("leukemia_type"),
        category.alias("category"),
        *[(8.0 * F.floor(uniform(*key, F.lit(c)) * 77)).cast("double").alias(c) for c in ("x", "y")],
        size[0].alias("w"), size[1].alias("h"), F.lit(640).alias("img_w"), F.lit(640).alias("img_h"),
        ann.alias("annotation_id"),
        F.when(F.col("l_orderkey") % 2 == 0, "a.json").otherwise("b.json").alias("source_json"))


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with simple numeric features; the resampling unit is the source. The features are taken before the
    labels are joined, so that no text is shuffled or sorted."""
    d, lab = table(spark, folder, "documents"), table(spark, folder, "labels")
    t = F.col("text")
    d = d.select("doc_id", F.col("source").alias("unit"), F.col("lang").alias("subtype"),
                 F.log(F.lit(1.0) + F.col("n_chars")).alias("f1"),
                 (F.length(t) - F.length(F.translate(t, "\n", ""))).cast("double").alias("f2"),
                 ((F.length(t) - F.length(F.translate(t, "0123456789", ""))).cast("double")
                  / F.col("n_chars").cast("double")).alias("f3"))
    j = d.join(lab, "doc_id")
    return j.select(F.col("doc_id").alias("item_id"), F.col("quality").alias("y"), "unit", "subtype", "f1", "f2", "f3")


def vector(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings in long form: one row per (item, position) with a region and a channel."""
    e = table(spark, folder, "embeddings")
    d = e.select(F.col("vec_id").alias("item_id"), F.col("label"), F.posexplode("embedding").alias("pos", "v"))
    return d.select("item_id", "label", "pos", F.when(F.col("pos") < 32, "a").otherwise("b").alias("region"),
                    (F.col("pos") % 4).alias("channel"), F.col("v").cast("double").alias("value"))


def heat_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as 8 x 8 heat maps with the central 4 x 4 block as the mask."""
    row, c = F.floor(F.col("pos") / 8).cast("int"), (F.col("pos") % 8).cast("int")
    return vector(spark, folder).select(
        "item_id", row.alias("row"), c.alias("col"), F.greatest(F.col("value") * 2.0, F.lit(0.0)).alias("heat"),
        (row.between(2, 5) & c.between(2, 5)).cast("int").alias("mask"), "value")


def grey_items(spark: SparkSession, folder: str) -> DataFrame:
    """8 x 8 grey grids per source: the embeddings, with exact copies of some and turned, rescaled copies of others."""
    e = table(spark, folder, "embeddings").withColumn("grid", F.transform("embedding", lambda v: v.cast("double")))
    base = e.select(F.concat(F.lit("s"), F.col("label").cast("string")).alias("source"),
                    F.col("vec_id").cast("string").alias("item_id"), "grid")
    # a quarter turn: out[r, c] = in[c, 7 - r]
    turned = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(
        "grid", ((i % 8) * 8 + 7 - F.floor(i / 8)).cast("int")) * F.lit(1.001))
    u = uniform("vec_id", F.lit("copy"))
    copies = e.filter(u < 0.3).select(
        F.concat(F.lit("copy"), (F.col("label") % 3).cast("string")).alias("source"),
        F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("item_id"),
        F.when(u < 0.1, F.col("grid")).otherwise(turned).alias("grid"))
    grey = F.transform("grid", lambda v: F.floor(v * 1000.0).cast("string"))
    return base.unionByName(copies).withColumn("content", F.concat_ws(",", grey))


def doc_features(spark: SparkSession, folder: str) -> DataFrame:
    """Local features of an item: one hashed code per non-empty line of a document; the class is its language."""
    d = table(spark, folder, "documents")
    lines = d.select(F.col("lang").alias("cls"), F.col("doc_id").alias("item_id"), F.explode(F.split("text", "\n")).alias("line"))
    code = F.conv(F.substring(F.md5("line"), 1, 15), 16, 10).cast("bigint")
    return lines.filter("line <> ''").select("cls", "item_id", code.alias("code"))


def train_log(spark: SparkSession, folder: str) -> DataFrame:
    """An append-only log per run; a run logs an epoch more than once, the latest arrival counts."""
    e = table(spark, folder, "events")
    arm = F.element_at(F.array(*[F.lit(a) for a in ("blend", "full", "jitter", "plain", "base")]),
                       (F.col("user_id") % 5 + 1).cast("int"))
    seed = F.floor(F.col("user_id") / 5).cast("bigint")
    return e.select(F.concat(F.lit("cls_"), arm, F.lit("_seed"), seed.cast("string")).alias("run_id"),
                    arm.alias("arm"), seed.alias("seed"), F.dayofmonth("ts").cast("bigint").alias("epoch"),
                    F.col("event_id").alias("arrival"), "ts",
                    grain(F.col("value") / (F.col("value") + 50.0)).alias("metric"),
                    (F.floor(uniform("event_id", F.lit("loss")) * 20) / 20.0).alias("loss"),
                    (uniform("event_id", F.lit("best")) < 0.1).cast("int").alias("is_best"),
                    F.to_json(F.create_map(F.lit("neg"), F.round(uniform("event_id", F.lit("n")), 3),
                                           F.lit("pos"), F.round(uniform("event_id", F.lit("q")), 3)))
                    .alias("per_class"))


GAUGES = ("proc_cpu_cores", "sys_cpu", "gpu_util", "gpu_mem_gb", "ram_used_gb", "ram_avail_gb", "shm_used_gb",
          "cores_saturated", "proc_rss_gb", "torch_alloc_gb", "torch_reserved_gb", "sampler_ms")


def resource_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Raw gauge samples; a gauge without a source reads NaN, as in the logs."""
    log = table(spark, folder, "events")
    phase = (F.when(F.col("event_type") == "click", "train").when(F.col("event_type") == "view", "val")
             .when(F.col("event_type") == "error", "train").otherwise("idle"))
    gauges = [F.when(uniform("event_id", F.lit(g)) < 0.1, F.lit(float("nan")))
              .otherwise(F.floor(uniform("event_id", F.lit(g), F.lit("v")) * 1000) / 10.0).alias(g) for g in GAUGES]
    return log.select(F.concat(F.lit("cls_a"), (F.col("user_id") % 7).cast("string"), F.lit("_seed"),
                               F.floor(F.col("user_id") / 7).cast("bigint").cast("string")).alias("run_id"),
                      F.dayofmonth("ts").cast("bigint").alias("epoch"), "ts", phase.alias("phase"), *gauges,
                      (F.lit(180.0) + 10 * (F.col("user_id") % 7)).alias("gpu_mem_total_gb"), F.lit(100.0).alias("ram_total_gb"),
                      F.lit(100.0).alias("shm_total_gb"), (F.col("user_id") % 7 + 8).cast("double").alias("cpu_count"),
                      F.floor(F.col("value")).alias("step_ms"),
                      F.floor(F.col("value") * uniform("event_id", F.lit("wait"))).alias("wait_ms"))


def duration_log(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    u = uniform("event_id", F.lit("status"))
    return e.select(F.col("event_type").alias("stage"), F.concat(F.lit("cell"), F.col("user_id").cast("string"))
                    .alias("cell"), F.col("value").alias("seconds"),
                    F.when(u < 0.7, "ok").when(u < 0.85, "skipped").when(u < 0.95, "failed").otherwise("interrupted")
                    .alias("status"))


INSTANCE_ROWS = 200_000


def bag_prediction(spark: SparkSession, folder: str) -> DataFrame:
    """The scores of the items, laid out like their instances in `instance_runs`."""
    return _scored(gather(items(spark, folder), ["item_id"], INSTANCE_ROWS, instance(spark, folder)))


def instance_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Instance scores of every run, at two scales. The instances of an item, which are few, come into one partition before they are
    repeated per run, so that groups of (run, item) shuffle none of the repeated rows."""
    runs = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(s).alias("seed"), F.lit(k).alias("scale"))
                               for a in ("full", "plain") for s in SEEDS for k in (0, 1)]))
    rows = gather(instance(spark, folder).select("item_id", "inst_id", "r", "p"), ["item_id"], INSTANCE_ROWS)
    d = rows.withColumn("run", runs).select("item_id", "inst_id", "r", "p", "run.*")
    p = grain(0.5 * F.col("p") + 0.5 * uniform("item_id", "inst_id", "arm", "seed", "scale"))
    return d.withColumn("p", once(p))
