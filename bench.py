"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of local cores. Every query is
run to the end with all of its columns (the `noop` sink), once, after a small warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import workload  # noqa: E402
from chronotag.model import session  # noqa: E402

HEADLINES = [
    "find_by_tags", "find_by_time", "match_saved_filters", "find_in_time_coordinate", "click_around_purchase",
    "cooccur_2", "cooccur_3", "cooccur_bound", "cooccur_or", "gather_tags",
    "tag_combinations", "count_event_tags", "store_stats", "state_changes", "set_end", "delete_events",
    "value_prev", "value_linear", "resample_grid", "recent_samples", "nearest_series", "decimate",
    "seq_timeout", "seq_gaps", "seq_summarize", "seq_phase_stack", "seq_regex",
    "rate", "turn_rate", "derivative_dx", "smooth", "running_total", "between_segments", "trajectory",
    "batch_features", "stored_results", "group_nearest", "from_to", "knn_predict", "pattern_matches",
    "change_feed", "online_state_changes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session("chronotag-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    workload.QUERIES["find_by_ids"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only or HEADLINES:
        begin = time.perf_counter()
        workload.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
