"""Every registered query of the statement engine against its SQL on the smallest tables."""

import pytest
from compare import differences, oracle

from daybook import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLES:
        assert not differences(df, con, registry.ORACLES[name])
    else:
        assert df.count() >= 0


def test_names_agree():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert registry.FLAGSHIP in registry.QUERIES
