import pytest
from oracle import compare, connect

from tessella import queries, queries_sites
from tessella.queries import flagship

QUERIES, SQL = queries.QUERIES | queries_sites.QUERIES, queries.SQL | queries_sites.SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    compare(spark, con, SF, QUERIES[name], SQL[name])


def test_flagship_and_pages(spark):
    assert flagship(spark, SF).count() == 5
    assert QUERIES["pages_rewritten"](spark, SF).where("bytes_saved < 0 or nodes_before = 0").count() == 0
