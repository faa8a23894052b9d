"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from evalspark.queries import REGISTRY  # noqa: E402

HEADLINE = ("leaderboard", "k08_roc_auc", "k09_average_precision", "k13_ece", "k21_cohort_metrics", "t01_youden", "f01_ensemble",
            "f03_bag_topk", "b02_draw_units", "b09_auc_ci", "b10_method_tests", "c06_greedy_iou_dedup", "c11_opposite_neighbour",
            "c20_canonical_groups", "d02_exact_overlap", "d06_near_duplicates", "d11_connected_components", "x09_swap_effects",
            "l05_curve_summary", "l11_resource_summary", "n04_moment_match", "n08_robust_filter")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["k12_brier"][0](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM and the file cache
    times = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
