"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is forced to full execution through the ``noop`` sink (no collect). An untimed
warm-up runs a few queries on the smallest scale first (JIT, codegen, Python workers), so
the first timed query is not charged for JVM start-up. ``value`` is the sum of the
per-query seconds, each the best of ``$BENCH_REPEATS`` runs (default 2; every run rebuilds
the query and its intermediate tables from scratch), which damps the noise of a shared VM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # flagship and evaluation family
    "flagship", "evaluation", "model_comparison", "auc", "pr_curve", "roc_curve", "roc_reduced", "best_threshold",
    "binary_metrics", "confusion", "log_loss", "weighted_log_loss", "epoch_metrics",
    # preparation
    "time_split", "class_counts", "balanced_sample", "balanced_sample_capped", "shuffle_order", "scaler_transform",
    "prepared",
    # catalog and derived tables
    "feature_groups", "group_profile", "feature_rank", "lag_groups", "interpolated", "source_merge",
    "wide_profile", "interpolated_long", "source_asof", "permutation_importance",
    # scoring
    "entropy_score", "dense_layer", "batch_norm", "layer_norm", "conv_features", "additive_score", "branch_concat",
    "frozen_features", "batch_score",
    # history and fitting
    "early_stop", "training_curves", "fit_logistic", "fit_mlp", "fit_additive", "fit_frozen_head", "evaluation_weighted",
    "fit_all", "fit_epochs", "fit_curves", "curve_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from kindling.session import build_session
    from kindling.plans.queries import QUERIES

    # BENCH_EVENT_LOG=<scratch dir> keeps Spark's event log for scripts/stage_times.py
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="kindling-bench",
                          event_log_dir=os.environ.get("BENCH_EVENT_LOG"))
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in ("class_counts", "flagship", "evaluation", "frozen_features"):  # untimed warm-up
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "2")))
    times = {}
    for name in names:
        best = float("inf")
        for _ in range(repeats):
            spark.sparkContext.setJobGroup(name, name)  # lets the event log be split per query
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t0)
        times[name] = round(best, 3)
    from kindling.session import drop_scratch_tables

    drop_scratch_tables(spark)  # intermediate tables of this run
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
