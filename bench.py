"""Headline queries on one machine; prints one JSON line.

Environment: BENCH_SF_DIR (folder of tables), BENCH_CPUS (cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lotwise.session import get_spark  # noqa: E402

import workload  # noqa: E402

HEADLINE = [
    "detail_facts",
    "cohort_valuation",
    "confidence_levels",
    "recommendation_bands",
    "best_deal_topk",
    "criteria_match_status",
    "classify_title",
    "risk_flags",
    "normalize_facts",
    "doc_tokens",
    "doc_near_duplicates",
    "contact_data_docs",
    "duplicate_pairs",
    "page_text",
    "page_cards",
    "article_cards",
    "price_changes",
    "lifecycle_state",
    "scan_stop_point",
    "collect_pages",
    "missed_listings",
    "overlay_corrections",
    "rule_join",
    "resolve_listing",
    "geo_distance",
    "quality_report",
    "next_capture_batch",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    workload.load()
    spark = get_spark("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        # Every row is worked out; nothing is brought to the driver.
        workload.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
