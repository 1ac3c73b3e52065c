"""Time the headline queries and print one JSON line.

Input folder: $BENCH_SF_DIR (default /root/testdata/sf0.1); cores: $BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "evidence_sample",
    "evidence_scores",
    "dedup_latest",
    "target_relevance",
    "polarity_overlap",
    "fingerprint_corroboration",
    "redaction_totals",
    "repeated_phrase",
    "entropy_tokens",
    "markdown_blocks",
    "line_changes",
    "exact_clusters",
    "merged_clusters",
    "contamination",
    "before_after_metrics",
    "snapshot_drift",
    "multiset_containment",
    "budget_packing",
    "sequence_conformance",
    "illegal_transitions",
    "bounded_closure",
    "lineage_chain",
    "best_support",
    "linked_components",
    "nomination_checks",
    "change_checks",
    "structural_collisions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from evidgrid.queries import QUERIES
    from evidgrid.session import build_session

    spark = build_session(
        app_name="bench",
        master=f"local[{cores}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cores,
        spark__driver__memory="12g",
        # The tables are single small files: one split each.
        evidgrid__read__partitions=cores,
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executors and compile the common code before the clock runs.
    QUERIES["evidence_scores"](spark, folder).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
