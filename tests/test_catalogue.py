"""Every catalogue query against its oracle, on the smallest tables."""

import pytest

from __spark_entry__ import entry
from tests.conftest import SF_DIR
from tests.oracle import compare, connect
from tidemark.plans.catalogue import QUERIES
from tidemark.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR) is None


def test_entry(spark):
    rows = {r["status"]: r["events"] for r in entry(spark).collect()}
    assert sum(rows.values()) == 1000 and set(rows) == {"PASS", "WARN", "FAIL"}
