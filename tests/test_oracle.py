"""Every query with an oracle: Spark result == DuckDB result (row count, columns, values).

Runs on sf0.001 by default (set RISKFRAME_TEST_SF to another folder).
"""

import os

import pytest

from tests.conftest import SMALL
from tests.oracle_harness import compare, duck

import __spark_entry__ as entry

SF = os.environ.get("RISKFRAME_TEST_SF", SMALL)
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("qid", sorted(ORACLES))
def test_query_matches_oracle(spark, con, qid):
    r = compare(spark, con, qid, QUERIES[qid], ORACLES[qid], SF)
    assert r["status"] in ("exact", "tolerant"), r


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["tipo_credito", "n", "approved"]
