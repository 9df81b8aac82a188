import pytest

from locusframe.plans import catalog

from .compare import DATA, assert_same, duck


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, DATA), catalog.ORACLE_SQL[name], con=con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_gives_rows_again(spark, name):
    first = catalog.QUERIES[name](spark, DATA)
    assert first.count() > 0
    assert sorted(map(str, first.collect())) == sorted(map(str, catalog.QUERIES[name](spark, DATA).collect()))


def test_overlap_join_is_an_equi_join(spark):
    plan = catalog.QUERIES["interval_overlap"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scan_reads_the_needed_columns(spark):
    plan = catalog.QUERIES["transcript_length"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_shipdate" not in plan
