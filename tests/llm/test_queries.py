"""The opN queries against their SQL, at the smallest scale."""

import pytest

from loomdoc.llm import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, connect(SF), name, registry.queries()[name], registry.oracle_sql()[name], SF)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
