import pytest
from compare import assert_same, connect

from kinetrail import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert_same(plans.queries()[name](spark, SF).toPandas(), con.execute(plans.oracle_sql()[name]).fetchdf())


def test_every_curve_is_fitted(spark):
    got = plans.queries()["kww_fit"](spark, SF).toPandas()
    assert sorted(got.onset) == list(range(10))
    assert got.tau_1e.notna().all()
