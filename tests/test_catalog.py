"""Registered queries against their SQL on DuckDB.

By default a cross-section runs on the smallest tables; SCORELAB_FULL=1 runs all.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_harness import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "metric_rows", "optimal_thresholds", "delong", "mcnemar", "calibration_summary", "rolling_origin_evaluation",
    "horizon_labels", "forward_membership", "stratified_folds", "prep_statistics_per_fold", "nominal_codes",
    "fairness_curve", "policy_evaluation", "bootstrap_intervals", "robustness_table", "explanation_quality",
    "friedman_nemenyi", "metric_summary", "smote_rows", "nominal_votes",
]
NAMES = list(entry.oracle_sql()) if os.environ.get("SCORELAB_FULL") else SAMPLE


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_is_stable(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "cutoff" and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    ok, message, _ = compare(spark, connect(SF_DIR), entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert ok, message
