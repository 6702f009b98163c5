"""Training-data queries that SQL can express, against that SQL."""

import oracle
import pytest
from gridloom.llm.queries import queries
from gridloom.llm.sql import oracle_sql


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_sql(spark, sf, name):
    assert not oracle.differences(queries()[name](spark, sf), oracle.connect(sf), oracle_sql()[name])
