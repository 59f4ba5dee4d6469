"""Wall seconds of headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all cores).
Every query writes its whole result to a sink that discards it. One untimed query
first starts the session's workers and loads classes.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "score_v2", "map_positions", "risk_metrics", "ic_metrics", "backtest_grid", "features_v1", "features_v2", "rank_pct",
    "ffill", "spike_clean", "split_three_way", "folds_expanding", "monthly_returns", "rolling_sharpe", "describe",
    "outlier_rate_iqr", "spearman_ic", "pair_self_join", "cluster_means", "density_curve", "auc_acc", "roc_points",
    "walk_forward_cv", "fit_ridge", "fit_forest",
]


def main() -> None:
    from serieswise.catalog import QUERIES
    from serieswise.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"), partitions=16)
    spark.sparkContext.setLogLevel("OFF")
    discard = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    discard("na_rate")
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        discard(name)
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_wall_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
