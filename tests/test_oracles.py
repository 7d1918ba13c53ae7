"""Every registered query against DuckDB on the smallest test tables."""

from __future__ import annotations

import os

import pytest

from compare import differences, duck
from workload.oracles import ORACLES
from workload.queries import QUERIES, bind

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_an_equivalent():
    """But for the approximate search, whose exact form has one; tests hold its recall against that."""
    assert set(QUERIES) - set(ORACLES) == {"similar_titles"} and set(ORACLES) < set(QUERIES)


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, con, name):
    assert differences(bind(QUERIES[name])(spark, SF_DIR), con, ORACLES[name]) is None


def test_flagship(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
