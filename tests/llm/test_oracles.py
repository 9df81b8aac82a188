import pytest

from locusframe.llm.queries import ORACLE_SQL, QUERIES

from ..compare import DATA, assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(QUERIES[name](spark, DATA), ORACLE_SQL[name])
