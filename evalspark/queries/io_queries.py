"""Files written from the tables and read back, and streams replayed in three waves."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators import runlog as L
from evalspark.plans.lineage import work_folder
from evalspark.queries.metrics_queries import R, rounded
from evalspark.queries.oracle import U, sql
from evalspark.queries.runlog_queries import LATEST, MEMORY
from evalspark.sources import io as S
from evalspark.sources import views as V
from evalspark.sources.tables import table
from evalspark.sources.versions import publish, read_published
from evalspark.streaming import stream as W

Q = {}
SHARD = 500  # rows per written document


def q(name, fn, body=None, **kw):
    Q[name] = (fn, sql(body, **kw) if body else None)


def predictions(s, d):
    """Every run as documents of parallel arrays under a folder named like its file."""
    p = V.prediction(s, d)
    shards = p.count() // SHARD + 1
    name = F.concat(F.lit("cls_"), "arm", F.lit("_seed"), F.col("seed").cast("string"), F.lit("_"), "cohort")
    docs = p.withColumn("file", name).groupBy("file", F.pmod(F.xxhash64("item_id"), F.lit(shards)).alias("shard")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("item_id").cast("string").alias("n"), "y", "p"))).alias("r"))
    docs = docs.select("file", F.col("r.y").alias("y_true"), F.transform("r", lambda x: F.array(1.0 - x["p"], x["p"])).alias("probs"),
                       F.col("r.n").alias("names"), F.lit("whole").alias("inference"))
    path = work_folder(s, "predictions")
    docs.write.partitionBy("file").json(path)
    return path


PRED = ["cohort", "arm", "seed", "item_id", "y", "p", "inference"]


def published(s, d):
    """A result replaced once, read through its pointer."""
    path = work_folder(s, "published")
    o = table(s, d, "orders")
    publish(o.limit(0), path)
    publish(o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderkey").alias("last")), path, ["o_orderpriority", "orders"])
    return read_published(s, path)


q("s01_read_wanted_runs", lambda s, d: S.read_predictions(s, predictions(s, d), ["val", "testb"], ["full"], [0, 2]).select(*PRED),
  f"""SELECT {R}, item_id::VARCHAR AS item_id, y, p, 'whole' AS inference FROM prediction WHERE cohort IN ('val', 'testb') AND arm = 'full' AND seed IN (0, 2)""")
q("s07_publish_result", published, "SELECT o_orderpriority, count(*) AS orders FROM orders GROUP BY ALL")
q("s01_read_predictions", lambda s, d: S.read_predictions(s, predictions(s, d)).select(*PRED), f"SELECT {R}, item_id::VARCHAR AS item_id, y, p, 'whole' AS inference FROM prediction")
CATS = ("lymph", "mono", "none", "blast")


def annotations(s, d):
    b = V.box(s, d)
    shards = b.count() // SHARD + 1
    cat = F.array_position(F.array(*[F.lit(c) for c in CATS]), F.col("category"))
    img = F.col("image").cast("bigint")
    docs = b.groupBy("source_json", F.pmod(F.xxhash64("annotation_id"), F.lit(shards)).alias("shard")).agg(
        F.collect_list(F.struct(img.alias("id"), "file_name", F.col("img_w").alias("width"), F.col("img_h").alias("height"))).alias("images"),
        F.collect_list(F.struct(F.col("annotation_id").alias("id"), img.alias("image_id"), cat.alias("category_id"),
                                F.array("x", "y", "w", "h").alias("bbox"))).alias("annotations"))
    docs = docs.withColumn("categories", F.array(*[F.struct(F.lit(i + 1).alias("id"), F.lit(c).alias("name")) for i, c in enumerate(CATS)]))
    path = work_folder(s, "annotations")
    docs.drop("shard").withColumn("doc", F.col("source_json")).drop("source_json").write.partitionBy("doc").json(path)
    return S.read_annotations(s, path)


q("s02_read_annotations", annotations,
  "SELECT file_name, slide, image, leukemia_type, category, x, y, w, h, img_w, img_h, annotation_id, source_json FROM box")


def labelled_files(s, d):
    path = work_folder(s, "files")
    f = V.items(s, d)
    for label, name in enumerate(("Normal", "ALL")):
        f.filter(F.col("y") == label).select(F.concat_ws(",", "item_id", "unit", "subtype").alias("value")).write.text(f"{path}/{name}")
    files = S.scan_labelled(s, [path], ("Normal", "ALL"), ("txt",))
    return files.groupBy("class_name", "label").agg(F.sum("length").alias("n_bytes"))


q("s03_scan_labelled", labelled_files, "SELECT CASE y WHEN 0 THEN 'Normal' ELSE 'ALL' END AS class_name, y AS label, sum(strlen(concat_ws(',', item_id, unit, subtype)) + 1)::BIGINT AS n_bytes FROM items GROUP BY ALL")
RULES = [("src0", "Normal", "A"), ("src1", "ALL", "B"), ("src2", "*", "C")]
q("s04_map_labels", lambda s, d: S.map_labels(table(s, d, "documents").select("source", F.concat_ws(
    "_", F.col("doc_id").cast("string"), (F.col("doc_id") % 2).cast("string")).alias("stem")), RULES),
  """SELECT source, doc_id || '_' || (doc_id % 2) AS stem, CASE source WHEN 'src0' THEN 'Normal' WHEN 'src1' THEN 'ALL' ELSE CASE WHEN doc_id % 2 = 1 THEN 'ALL' ELSE 'Normal' END END
 AS class_name, CASE source WHEN 'src0' THEN 'A' WHEN 'src1' THEN 'B' ELSE 'C' END || '_' || doc_id || '_' || (doc_id % 2) || '.png' AS file FROM documents
 WHERE source IN ('src0', 'src1', 'src2')""")
LOG = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("run_id", T.StringType()), T.StructField("epoch", T.LongType()),
                    T.StructField("gpu_util", T.DoubleType())])


def log_lines(s, d, order, odd):
    """The odd or even events of the gauge log as text lines, some torn, some with a column too many."""
    e = table(s, d, "events").filter(F.col("event_id") % 2 == odd)
    from evalspark.functions.columns import uniform
    u = uniform("event_id", F.lit("torn"))
    g = F.when(uniform("event_id", F.lit("gpu")) < 0.1, F.lit("NaN")).otherwise(F.floor(F.col("value")).cast("string"))
    cells = dict(zip(LOG.names, (F.col("event_id").cast("string"), F.concat(F.lit("u"), F.col("user_id").cast("string")),
                                 F.dayofmonth("ts").cast("string"), g)))
    full = F.concat_ws(",", *[cells[n] for n in order])
    return e.select(F.when(u < 0.05, F.concat_ws(",", F.col("event_id").cast("string"), F.lit("u")))
                    .when(u < 0.1, F.concat(full, F.lit(",extra"))).otherwise(full).alias("value"))


TORN = f"""SELECT event_id, 'u' || user_id AS run_id, day(ts)::BIGINT AS epoch, CASE WHEN {U("event_id", "'gpu'")} >= 0.1::DOUBLE THEN floor(value) END AS gpu_util
 FROM events WHERE {U("event_id", "'torn'")} >= 0.1::DOUBLE"""


def log_files(s, d, path):
    """The log as files of two column orders, and files of another log."""
    lines = table(s, d, "events").select(F.col("event_id").cast("string"), "event_type")
    sets = [(order, log_lines(s, d, order, odd)) for odd, order in enumerate((LOG.names, LOG.names[::-1]))]
    for names, rows in [*sets, (["event_id", "kind"], lines.select(F.concat_ws(",", "event_id", "event_type")))]:
        # the names as one column name, and a separator that no line holds: each file gets its header, lines stay as they are
        rows.toDF(",".join(names)).write.mode("append").option("header", "true").option("sep", "\x01").option("quote", "").csv(path)
    return path


q("s05_read_log", lambda s, d: S.read_log(s, log_files(s, d, work_folder(s, "log")), LOG), TORN)


def append_twice(s, d):
    path = work_folder(s, "append")
    log = V.train_log(s, d).select("run_id", "epoch", "arrival", "metric")
    S.append_log(log.filter("epoch <= 15"), path)
    S.append_log(log.filter("epoch > 15"), path)
    return S.read_log(s, path, log.schema)


q("s06_append_log", append_twice, "SELECT run_id, epoch, arrival, metric FROM train_log")


def result(columns=None, fmt="parquet"):
    def run(s, d):
        path = work_folder(s, "result")
        t = L.curve_band(L.latest_epoch(V.train_log(s, d))).withColumnRenamed("sd", "spread")
        S.write_result(t.limit(1), path, columns, fmt)
        S.write_result(t, path, columns, fmt)
        back = s.read.schema(t.select(*columns).schema if columns else t.schema).format(fmt).load(path)
        return rounded(back)
    return run


BAND = "SELECT arm, epoch, count(*) AS seeds, round(avg(metric), 6) AS mean, round(stddev_samp(metric), 6) AS spread FROM latest GROUP BY ALL"
q("s07_write_result", result(), BAND, latest=LATEST)
q("s08_write_columns", result(["arm", "epoch", "mean"], "json"), f"SELECT arm, epoch, mean FROM ({BAND})", latest=LATEST)


def groups(s, d):
    o = table(s, d, "orders")
    return S.import_groups(o.select(F.col("o_orderstatus").alias("class_name"), F.concat(F.lit("raw/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"),
                                                                                      F.lit(".jpg")).alias("relative_path"), F.col("o_custkey").alias("group")))


q("s09_import_groups", groups,
  """SELECT file, class_name, group_id, dense_rank() OVER (ORDER BY f) - 1 AS group_no FROM (SELECT *, min(file) OVER (PARTITION BY group_id) AS f FROM (SELECT
 'item_' || o_orderstatus || '_' || lpad(o_orderkey::VARCHAR, 12, '0') || '.png' AS file, o_orderstatus AS class_name, o_custkey AS group_id FROM orders))""")

WAVES = ["epoch <= 10", "epoch > 10 AND epoch <= 20", "epoch > 20"]


def samples(s, d):
    return V.resource_sample(s, d).withColumn("ts", F.col("ts").cast("timestamp"))


def followed_log(s, d):
    base = work_folder(s, "follow")
    W.run_to_table(W.stream_log(s, log_files(s, d, f"{base}/in"), LOG), f"{base}/out", f"{base}/checkpoint")
    return s.read.parquet(f"{base}/out")


q("w01_stream_log", followed_log, TORN)


def windows(s, d):
    out = W.replay(s, samples(s, d), WAVES, lambda x: W.stream_resources(x))
    return s.read.parquet(out)


WIN = """SELECT epoch_us(date_trunc('day', ts)) // 86400000000 AS day, run_id, phase, avg(gpu_util) AS gpu_util_mean, avg(sys_cpu) AS sys_cpu_mean, greatest(max(torch_reserved_gb), max(gpu_mem_gb)) AS vram_peak_gb,
 max(gpu_mem_gb) AS gpu_mem_peak_gb, max(gpu_mem_total_gb) AS gpu_mem_total_gb, max(ram_total_gb) AS ram_total_gb, max(shm_total_gb) AS shm_total_gb,
 min(ram_avail_gb) AS ram_avail_min_gb, max(shm_used_gb) AS shm_used_peak_gb, sum(wait_ms)::BIGINT AS wait_ms, sum(step_ms)::BIGINT AS busy_ms, count(*) AS samples
 FROM resource_sample WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM resource_sample) GROUP BY ALL"""


def by_day(t):
    return t.withColumn("day", F.floor(F.unix_micros("window_start") / F.lit(86400000000)).cast("bigint")).drop("window_start", "window_end")


q("w02_stream_resources", lambda s, d: rounded(by_day(windows(s, d))),
  "SELECT * REPLACE (round(gpu_util_mean, 6) AS gpu_util_mean, round(sys_cpu_mean, 6) AS sys_cpu_mean) FROM wins", wins=WIN)


def timing(s, d):
    out = W.replay(s, samples(s, d), WAVES, W.stream_timing, "update")
    t = s.read.parquet(out)
    return t.groupBy("run_id", "epoch", "phase").agg(*[F.max_by(c, "__batch").alias(c) for c in ("busy_ms", "wait_ms", "steps")])


q("w03_stream_timing", timing,
  "SELECT run_id, epoch, phase, sum(step_ms)::BIGINT AS busy_ms, sum(wait_ms)::BIGINT AS wait_ms, count(*) AS steps FROM resource_sample GROUP BY ALL")


THIRDS = ["epoch % 3 = 0", "epoch % 3 = 2", "epoch % 3 = 1"]  # every epoch but each third arrives ahead of its turn


def best(s, d):
    log = L.latest_epoch(V.train_log(s, d)).select("run_id", "epoch", F.col("ts").cast("timestamp").alias("ts"), "metric", "loss")
    # a run skips days, so some epochs wait behind a gap until the log has moved on and their run is over
    tick = log.agg(F.lit("~clock").alias("run_id"), F.lit(1).cast("bigint").alias("epoch"), (F.max("ts") + F.expr("INTERVAL 200 DAYS")).alias("ts"),
                   F.lit(None).cast("double").alias("metric"), F.lit(None).cast("double").alias("loss"))
    out = W.replay(s, log.unionByName(tick), [*THIRDS[:2], f"{THIRDS[2]} AND run_id <> '~clock'", "run_id = '~clock'"], lambda x: W.stream_best(x, "60 days"))
    return s.read.parquet(out).filter("run_id <> '~clock'")


q("w04_stream_best", best,
  """SELECT run_id, epoch, metric, loss, (pb IS NULL OR metric > (pb).m OR (metric = (pb).m AND loss < -(pb).l))::INT AS best FROM (SELECT *, max({'m': metric, 'l': -loss}) OVER
 (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM latest)""", latest=LATEST)


def latest_rows(s, d):
    base = work_folder(s, "latest")
    log = V.train_log(s, d).select("run_id", "epoch", "arrival", "metric")
    for wave in ("arrival % 3 = 0", "arrival % 3 = 1", "arrival % 3 = 2"):
        log.filter(wave).write.mode("append").parquet(f"{base}/in")
        source = s.readStream.schema(log.schema).parquet(f"{base}/in")
        source.writeStream.foreachBatch(W.latest_sink(f"{base}/out", compact=2)).option("checkpointLocation", f"{base}/checkpoint").trigger(
            availableNow=True).start().awaitTermination()
    return W.read_latest(s, f"{base}/out")


q("w05_stream_latest", latest_rows, "SELECT run_id, epoch, arrival, metric FROM latest", latest=LATEST)
q("w06_stream_flags", lambda s, d: by_day(W.stream_flags(windows(s, d))).select("day", "run_id", "phase", F.concat_ws("; ", "flags").alias("flags")),
  f"""SELECT day, run_id, phase, array_to_string(list_filter([CASE WHEN phase = 'train' AND gpu_util_mean < 70 AND wait_ms / nullif(busy_ms, 0) > 0.2::DOUBLE THEN 'input-bound' END,
 CASE WHEN phase = 'val' AND wait_ms / nullif(busy_ms, 0) > 0.2::DOUBLE THEN 'val input-bound' END, {MEMORY}], lambda x: x IS NOT NULL), '; ') AS flags FROM wins""", wins=WIN)
