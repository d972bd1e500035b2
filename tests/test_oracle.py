"""Every registered query against its SQL on the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
import oracle_check

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return oracle_check.connect(SF)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    text, good = oracle_check.compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SF)
    assert good, text


def test_entry(spark):
    assert entry.entry(spark).count() > 0
