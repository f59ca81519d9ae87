"""Times the headline queries once each, after one warm-up query, and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from gridsquall.plans import registry
from gridsquall.session import build

HEADLINE = (
    "A1_parquet_scan", "B2_censoring_report", "B6_clear_sky_index", "C4_asof_nearest", "C6_nearest_in_window", "D1_daily_max_matrix", "D4_group_quantiles",
    "D6_tail_dependence_chi", "D14_pair_event_summary", "D16_spearman", "E1_swinging_door", "E6_runs_declustering", "E8_extremal_index", "H4_marginal_pipeline", "H12_real_ensemble",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["D2_grouped_counts_pivot"](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        t = time.perf_counter()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))[2:]}))
    spark.stop()


if __name__ == "__main__":
    main()
