"""Every named query against its SQL."""

import oracle
import pytest
from gridloom.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    assert not oracle.differences(catalogue.QUERIES[name](spark, sf), con, catalogue.SQL[name])
