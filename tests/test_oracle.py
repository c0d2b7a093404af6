"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import pytest

from tools.compare_oracle import compare, duck

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def _names():
    from contrasta.plans.catalog import QUERIES
    return list(QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    from contrasta.plans.catalog import QUERIES
    from contrasta.plans.oracle import ORACLE
    assert compare(QUERIES[name](spark, SF), con, ORACLE[name]()) is None
