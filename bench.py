"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores, BENCH_QUERIES a
comma-separated choice of queries. Each query is written to the noop sink: once to warm up, then
BENCH_REPEAT times, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from caseflow.session import local_session  # noqa: E402
from caseflow.sources.sinks import remove_staged  # noqa: E402
from standins.catalogue import QUERIES  # noqa: E402

HEADLINE = (
    "merged_timeline", "timeline_text", "sectioned_timeline", "labs_extract", "diagnosis_timing", "notes_by_type",
    "nearest_unbounded", "pf_series", "sofa_sliding", "sofa_anchored", "numeric_crosscheck",
    "score_table_text", "pf_table_text", "claim_id_lists", "letter_library", "letter_sections",
    "template_match_top1", "timeline_text_capped", "denial_page_split", "duplicate_letters", "scan_confidence", "template_match_topk",
    "guideline_match", "workqueue_population", "address_mapping", "claim_rollup", "spine_features",
    "incremental_unscored", "insert_unseen", "condition_type",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, cpus)
    seconds = {}
    for name in names:
        runs = []
        for _ in range(repeat + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "shuffle_partitions": cpus,
            }
        )
    )
    remove_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
