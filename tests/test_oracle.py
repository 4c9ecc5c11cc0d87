"""Every registered query agrees with its SQL on the smallest supplied scale."""

import os

import pytest

from opsmetrics.plans.catalogue import ORACLE, QUERIES

from .oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
LARGER = os.path.join(os.path.dirname(SF), "sf0.01")  # for queries whose condition no row of the smallest scale meets


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, text = compare(spark, duck, name, QUERIES[name], ORACLE.get(name), SF)
    if text.startswith("rows=0 "):
        ok, text = compare(spark, connect(LARGER), name, QUERIES[name], ORACLE.get(name), LARGER)
    assert ok, text


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
