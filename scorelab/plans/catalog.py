"""All registered queries."""

from __future__ import annotations

from scorelab.plans import analysis_queries, data_queries, fairness_queries, metric_queries, model_queries, resample_queries  # noqa: F401
from scorelab.plans.base import CATALOG, ORACLES


def queries():
    return dict(CATALOG)


def oracle_sql():
    return dict(ORACLES)
