"""Time the headline queries: one JSON line with the median of warm runs per query."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from terrapanel.plans import load_queries  # noqa: E402
from terrapanel.session import build_session  # noqa: E402

HEADLINE = [
    "daily_panel",
    "training_panel",
    "label_panel",
    "examples_panel",
    "nearest_cell",
    "knn_cells",
    "point_in_polygon",
    "cell_clip_area",
    "terrain_slope",
    "landcover_fraction",
    "raster_decode",
    "neighbor_lag_sum",
    "radius_mean",
    "cube_nearest_fill",
    "gap_fill_linear",
    "vegetation_features",
    "factor_outer_merge",
    "incident_clean",
    "detection_clean",
    "preamble_scan",
    "link_harvest",
    "summary_stats",
    "impute_median",
    "stratified_split",
    "roc_auc_ap",
    "threshold_sweep",
    "qa_violations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = os.environ.get("BENCH_QUERIES")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, os.environ.get("BENCH_CHECKPOINTS") or tempfile.mkdtemp(prefix="bench-checkpoints-"))
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in only.split(",") if only else HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registry[name].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
