import pytest

from tests.oracle import check, connect
from treeblock.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_oracle(spark, sf, duck, name):
    check(QUERIES[name](spark, sf), duck, ORACLE[name])


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.count() == 80
    assert set(QUERIES) <= set(__spark_entry__.queries())
