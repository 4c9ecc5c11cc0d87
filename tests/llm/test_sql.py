"""Every query of the subpackage that has SQL agrees with it on the smallest supplied scale."""

import os

import pytest

from opsmetrics.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables not present")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    ok, text = compare(spark, connect(SF), name, QUERIES[name], ORACLE[name], SF)
    assert ok, text
