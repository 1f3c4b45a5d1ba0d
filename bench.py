"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import registry  # noqa: E402
from cladeflow import get_spark  # noqa: E402

HEADLINES = (
    "c01_window_sequences", "c06_split_windows", "c07_dataset_stats", "c03_both_strands", "a17_tetramer_freq",
    "a03_assembly_stats", "a13_aggregate_chunks", "a18_hits_lca", "a19_aggregate_orfs", "a20_taxonomic_accuracy",
    "a24_roc_curve", "f08_encode", "f10_revcomp", "j02_resolve_labels", "j09_asof_last", "j11_expand_distances",
    "j14_reconcile", "j15_roll_up", "o04_nearest", "w01_cum_offsets", "w02_islands", "w10_balanced_buckets",
    "g02_patristic", "g06_fuzzy_graph", "x01_score_windows", "x02_infer_summary",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or [n for n in HEADLINES if n in registry.QUERIES]
    spark = get_spark(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_median_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
