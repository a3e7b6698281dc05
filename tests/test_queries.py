"""Registered queries beside their SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = [
    "d03_carry_forward", "d09_integrate_power", "c03_session_soc", "k09_k10_k11_charging_kpis", "h03_health_penalty", "g07_recompute_rankings",
    "i01_i13_validate_batches", "i00_malformed", "i14_classify_batches", "s10_replace_rankings", "s14_raw_rows_to_batches", "d04_complete_deltas", "r07_batch_receipts", "q04_readiness", "q07_deep_page", "q12_raw_with_events", "v01_check_violations",
    "x11_to_observations", "x12_diagnostic_changes", "t02_dedupe_stream", "t03_sessions_stream", "e01_cohort_fallback",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    assert compare(duck(SF), entry.queries()[name](spark, SF), entry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    from coverage_queries import base

    assert set(base.QUERIES) == set(base.SQL) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
