"""The corpus queries that have SQL against it, on the smallest tables."""

import pytest
from compare import differences, oracle

from daybook.llm.oracles import ORACLES
from daybook.llm.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, sf_dir, con, name):
    assert not differences(QUERIES[name](spark, sf_dir), con, ORACLES[name])
