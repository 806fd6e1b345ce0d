
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskframe.plans.fixture_sql import with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(qid: str, sql: str | None = None, extra_ctes: dict[str, str] | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``qid``.

    ``sql`` is the DuckDB oracle body; it can use the fixture views
    (applications, evaluations, truth_labels, users_dim, visits, inverted,
    dirty) besides the driver tables.
    """
    def deco(fn: QueryFn) -> QueryFn:
        if qid in QUERIES:
            raise ValueError(f"duplicate query id {qid}")
        QUERIES[qid] = fn
        if sql is not None:
            ORACLES[qid] = with_fixtures(sql, extra_ctes)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from riskframe.plans import (q_cleaning, q_features, q_joins, q_metrics, q_models,  # noqa: F401
                                 q_monitoring, q_scalar, q_sources, q_streaming)
