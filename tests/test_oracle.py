"""Every query of the library proper against its SQL, at the smallest scale."""

import pytest

from loomdoc.plans import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        compare(spark, con, name, QUERIES[name], SQL[name], SF)
    else:
        assert QUERIES[name](spark, SF).columns
