"""The queries that SQL can state, against it."""

import pytest

from tests.parity import compare, duck
from vigilflow.llm import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, name):
    assert compare(spark, duck(SF), name, catalogue.QUERIES[name], catalogue.ORACLES[name], SF) == ""
