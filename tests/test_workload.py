"""Registered queries against their SQL twins on the smallest tables."""

import pytest

import workload
from tools.check_oracle import compare, oracle

FOLDER = "/root/testdata/sf0.001"
workload.load()

# One or more of every kind; tools/check_oracle.py runs them all.
CHECKED = [
    "cohort_valuation",
    "recommendation_bands",
    "criteria_match_status",
    "classify_title",
    "normalize_facts",
    "doc_near_duplicates",
    "duplicate_pairs",
    "hash_pairs",
    "price_changes",
    "lifecycle_state",
    "scan_stop_point",
    "collect_pages",
    "page_cards",
    "article_cards",
    "labelled_pairs",
    "overlay_corrections",
    "rule_join",
    "resolve_listing",
    "geo_distance",
    "json_validate",
    "next_capture_batch",
    "lifecycle_stream",
    "late_observations",
    "enrichment_queue_state",
    "correct_and_reassess",
    "scan_stop_rules",
    "page_class",
    "model_batch",
    "valuation_texts",
    "seller_texts",
    "dhash64",
    "blocked_searches",
    "replay_dedupe",
]


@pytest.fixture(scope="module")
def database():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_agrees_with_sql(spark, database, name):
    ok, note, _ = compare(spark, database, FOLDER, name, workload.QUERIES[name], workload.ORACLE[name])
    assert ok, note


def test_every_sql_twin_has_a_query():
    assert set(workload.ORACLE) <= set(workload.QUERIES)
