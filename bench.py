"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run to the end into a sink that keeps nothing. Writing the input tables
(readings, panel, features, windows) is timed under its own names and counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

STAGES = ["readings", "weather", "panel", "panel_filled", "features", "windows", "wide"]
HEADLINE = [
    "unpivot_readings", "join_locations", "asof_weather", "weather_cache_join", "panel_summary", "get_panel_subset",
    "lag_usage", "rolling_sums", "build_features", "norm_stats", "day_windows", "sliding_windows", "training_tensors",
    "hurdle_encode", "window_condition_means", "mean_profile_by_source", "profile_compare", "wasserstein_1d",
    "magnitude_histogram", "magnitude_density", "lag_usage_by_time", "adversarial_features", "best_of_n", "home_labels", "burst_stats", "interarrival",
    "autocorrelation", "forward_noise", "gaussian_predictor", "scenario_encode", "to_sequences", "dtw_pairs",
    "dba_archetype", "monthly_dtw", "monthly_archetypes", "history_distances", "reverse_sample", "adversarial_rf", "adversarial_gbt", "write_panel",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from flowpanel.catalog import PLAIN, Inputs

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    inputs = Inputs(spark, sf_dir)
    steps = {
        "readings": inputs.readings, "weather": inputs.weather, "panel": inputs.panel,
        "panel_filled": lambda: inputs.panel(True), "features": inputs.features, "windows": inputs.windows,
        "wide": inputs.wide,
    }
    inputs.table("events").count()  # start the session before the clock
    times: dict[str, float] = {}
    for name in STAGES:
        start = time.perf_counter()
        steps[name]()
        times[f"stage_{name}"] = round(time.perf_counter() - start, 3)
    inputs.stats()
    inputs.hot()
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        PLAIN[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:26s} {times[name]:8.2f}", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
