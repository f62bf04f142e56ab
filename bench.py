"""Run the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), and BENCH_QUERIES, a
comma-separated list of names or ``all``.
"""

import json
import os
import time

from gridprobe.catalog import QUERIES
from gridprobe.session import local_session

HEADLINE = [
    # grids and theory
    "note_labels", "interval_labels", "progression_labels", "tempo_labels", "diatonic_chords", "named_chords",
    "sweep_handcrafted",
    # sequences
    "interval_patterns", "melody_messages", "click_track_durations",
    # signals
    "peak_normalised", "moment_pooling", "extracted_moments", "pooled_layers",
    # labels, scaling, splits
    "encoded_languages", "scaled_prices", "dimension_statistics", "standardised_vectors", "label_distribution_per_split",
    "extrapolation_split_events", "dense_positions",
    # metrics and logs
    "evaluated_splits", "confusion_matrix", "regression_scores", "early_stopping", "best_layer_per_model",
    # jobs
    "flat_manifest", "pending_samples", "latest_shard_status", "run_plan", "matched_exports", "text_checksums",
    # probes and streams
    "linear_probe", "streamed_event_statistics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES")
    names = HEADLINE if not wanted else list(QUERIES) if wanted == "all" else wanted.split(",")
    spark = local_session("gridprobe-bench", os.environ.get("BENCH_CPUS", "8"))
    # Start the JVM's file and code paths before the clock runs.
    spark.read.parquet(f"{folder}/region.parquet").groupBy("r_name").count().collect()
    times = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
