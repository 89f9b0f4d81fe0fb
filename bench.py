"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores;
BENCH_QUERIES may name a subset.
"""

from __future__ import annotations

import json
import os
import time

from fluxfold.plans.catalog import QUERIES
from fluxfold.session import local_session

HEADLINE = (
    "scan_parquet_table merge_and_label_tces labels_distribution normalize_scalars group_split "
    "phase_fold split_at_gaps scaled_diffs mad_sigma robust_mean mask_events interpolate_masked "
    "mark_transits normalize_by_median assign_bins sort_folded local_view global_view "
    "odd_even_views secondary_views join_features ingest_light_curve_files flatten_series "
    "create_features"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
