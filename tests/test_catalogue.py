import pytest
from oracle import compare, connect

from veduta.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(name, spark, con):
    got, want = compare(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLES[name])
    assert got == want
