"""Structured Streaming over append-only logs: the batch log operators, incrementally."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evalspark.functions.columns import nan_to_null, ratio
from evalspark.operators.runlog import LIMITS, flag_list, latest_epoch, memory_rules
from evalspark.plans.lineage import work_folder
from evalspark.sources.io import header_names, is_header, parse_log
from evalspark.sources.versions import Folder


def stream_log(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Follow an append-only CSV log, skipping torn and foreign rows. Columns are found by the header of each file, as in
    the batch reader; a file is what one append wrote, and is read as a whole."""
    r = spark.readStream
    r = r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r
    files = r.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("lines")).filter(is_header(F.col("lines")[0], schema))
    # the names are made below the generator, so that a line does not carry its whole file along
    lines = files.select(header_names(F.col("lines")[0]).alias("names"), "lines").select("names", F.explode("lines").alias("value"))
    return parse_log(lines.filter((F.col("value") != "") & ~is_header(F.col("value"), schema)), schema)


def stream_resources(s: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Means and peaks per run and phase in tumbling windows, emitted once a window is closed by the watermark."""
    g = {c: nan_to_null(c) for c in ("gpu_util", "sys_cpu", "gpu_mem_gb", "torch_reserved_gb", "ram_avail_gb", "shm_used_gb")}
    t = s.withWatermark("ts", delay).groupBy(F.window("ts", width), "run_id", "phase").agg(
        F.avg(g["gpu_util"]).alias("gpu_util_mean"), F.avg(g["sys_cpu"]).alias("sys_cpu_mean"), F.greatest(F.max(g["torch_reserved_gb"]), F.max(g["gpu_mem_gb"])).alias("vram_peak_gb"), F.max(g["gpu_mem_gb"]).alias("gpu_mem_peak_gb"),
        *[F.max(c).alias(c) for c in ("gpu_mem_total_gb", "ram_total_gb", "shm_total_gb")],
        F.min(g["ram_avail_gb"]).alias("ram_avail_min_gb"), F.max(g["shm_used_gb"]).alias("shm_used_peak_gb"),
        F.sum("wait_ms").alias("wait_ms"), F.sum("step_ms").alias("busy_ms"), F.count(F.lit(1)).alias("samples"))
    return t.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "run_id", "phase",
                    *[c for c in t.columns if c not in ("window", "run_id", "phase")])


def stream_timing(s: DataFrame) -> DataFrame:
    """Waiting, busy time and steps per run, epoch and phase (update mode); a new epoch starts from zero."""
    return s.groupBy("run_id", "epoch", "phase").agg(F.sum("step_ms").alias("busy_ms"), F.sum("wait_ms").alias("wait_ms"),
                                                     F.count(F.lit(1)).alias("steps"))


def stream_flags(windows: DataFrame) -> DataFrame:
    """Bottleneck flags of every closed window."""
    waits = ratio("wait_ms", "busy_ms") > LIMITS["wait"]
    rules = {"input-bound": (F.col("phase") == "train") & (F.col("gpu_util_mean") < LIMITS["gpu_util"]) & waits,
             "val input-bound": (F.col("phase") == "val") & waits}
    return windows.withColumn("flags", flag_list(rules | memory_rules()))


BEST = "run_id string, epoch bigint, metric double, loss double, best int"
KEPT = "metric double, loss double, following bigint, timer bigint"


class RunningBest(StatefulProcessor):
    """Best-so-far flags in epoch order. A run's state is its best (metric, loss), the next epoch and, by epoch, the rows
    that came ahead of it. An epoch that is next leaves at once, so a run in order holds nothing. A run whose
    newest row is `delay` behind the watermark is over: what it holds leaves in epoch order, and its state goes."""

    def __init__(self, first: int, delay_ms: int):
        self.first, self.delay_ms = first, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", KEPT)
        self.ahead = handle.getMapState("ahead", "epoch bigint", "metric double, loss double")

    def _judge(self, best: tuple, metric, loss) -> tuple[tuple, int]:
        if metric is None or metric != metric:
            return best, 0
        better = best[0] is None or metric > best[0] or (metric == best[0] and loss < best[1])
        return ((float(metric), float(loss)), 1) if better else (best, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        metric, loss, following, timer = self.kept.get() if self.kept.exists() else (None, None, self.first, -1)
        best, newest, held = (metric, loss), timer, self.ahead.exists()
        for frame in rows:
            out = []
            # `rows` is a stream of frames of bounded size; only a frame is sorted, what is ahead waits in the state
            for epoch, m, x, at in frame.sort_values("epoch", kind="mergesort")[["epoch", "metric", "loss", "at"]].itertuples(index=False):
                newest = max(newest, int(at))
                if epoch > following:
                    self.ahead.updateValue((int(epoch),), (None if m != m else float(m), None if x != x else float(x)))
                    held = True
                    continue
                best, flag = self._judge(best, m, x)
                out.append((key[0], int(epoch), m, x, flag))
                following = max(following, int(epoch) + 1)
                while held and self.ahead.containsKey((following,)):
                    m, x = self.ahead.getValue((following,))
                    self.ahead.removeKey((following,))
                    best, flag = self._judge(best, m, x)
                    out.append((key[0], following, m, x, flag))
                    following += 1
            if out:
                yield pd.DataFrame(out, columns=["run_id", "epoch", "metric", "loss", "best"])
        if newest != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer + self.delay_ms)
            self.handle.registerTimer(newest + self.delay_ms)
        self.kept.update((*best, following, newest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best, out = self.kept.get()[:2], []
        for (epoch,), (m, x) in sorted(self.ahead.iterator(), key=lambda e: e[0]):
            best, flag = self._judge(best, m, x)
            out.append((key[0], epoch, m, x, flag))
        self.ahead.clear()
        self.kept.clear()
        if out:
            yield pd.DataFrame(out, columns=["run_id", "epoch", "metric", "loss", "best"])

    def close(self) -> None:
        pass


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_best(s: DataFrame, delay: str = "7 days", first: int = 1) -> DataFrame:
    """Best-so-far flag of every epoch of (run_id, epoch, ts, metric, loss), in epoch order even if epochs arrive out of it;
    `first` is a run's first epoch. A row more than `delay` behind the newest is late and left out, and a run that has been
    silent for `delay` is over: epochs behind a gap that nobody filled leave then. An epoch logged again is judged against
    the best so far. The state lives in RocksDB (`run_to_table` sets STATE_STORE)."""
    ms = int(pd.Timedelta(delay).total_seconds() * 1000)
    t = s.withWatermark("ts", delay).select("run_id", "epoch", "metric", "loss", "ts", F.unix_millis("ts").alias("at"))
    return t.groupBy("run_id").transformWithStateInPandas(RunningBest(first, ms), BEST, "Append", "EventTime")


def latest_sink(path: str, compact: int = 10):
    """foreachBatch writer: the last row per (run, epoch) of each batch in a folder of its own, then a pointer that lists what
    belongs to the table. After `compact` batches they are merged with the snapshot into a new one, so reading costs the
    same however many batches there were. A batch that is delivered again is known by its number and changes nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = Folder(spark, path)
        at = folder.pointer() or {"snapshot": None, "batches": [], "last": -1, "old": []}
        if batch_id <= at["last"]:
            return
        name = f"batch-{batch_id}"
        latest_epoch(batch).write.mode("overwrite").parquet(f"{folder.path}/{name}")
        at = {**at, "batches": [*at["batches"], name], "last": batch_id}
        folder.point(at)
        if len(at["batches"]) >= compact:
            snapshot = f"snapshot-{batch_id}"
            read_latest(spark, path).write.mode("overwrite").parquet(f"{folder.path}/{snapshot}")
            gone = [*at["batches"], *([at["snapshot"]] if at["snapshot"] else [])]
            folder.point({"snapshot": snapshot, "batches": [], "last": batch_id, "old": gone})
            for old in at["old"]:  # folders of the compaction before the last one, which no reader uses any more
                folder.drop(old)
    return write


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Last row per (run, epoch) over everything written by `latest_sink`: the snapshot and the batches since."""
    at = Folder(spark, path).pointer()
    if at is None:
        raise FileNotFoundError(f"nothing has been written to {path}")
    parts = [*([at["snapshot"]] if at["snapshot"] else []), *at["batches"]]
    return latest_epoch(spark.read.parquet(*[f"{path.rstrip('/')}/{p}" for p in parts]))


def stream_distinct(s: DataFrame, keys: Sequence[str], delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """Rows that are delivered more than once within `delay` of event time pass once; keys leave the state after that."""
    return s.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available and stop. Update mode keeps one folder per batch."""
    stream.sparkSession.conf.set(*STATE_STORE)
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").start(out)
    else:
        q = w.outputMode(mode).foreachBatch(lambda b, i: b.withColumn("__batch", F.lit(i)).write.mode("overwrite")
                                            .parquet(f"{out}/batch={i}")).start()
    q.awaitTermination()


def replay(spark: SparkSession, rows: DataFrame, waves: Sequence, follow, mode: str = "append"):
    """Append `rows` to a folder wave by wave (a wave is a filter) and let the stream `follow(source)` catch up after each;
    returns the output folder."""
    base = work_folder(spark, "replay")
    for i, wave in enumerate(waves):
        rows.filter(wave).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        run_to_table(follow(source), f"{base}/out", f"{base}/checkpoint", mode)
    return f"{base}/out"
