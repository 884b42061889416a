import pytest

from tests.compare import difference, duck
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert difference(spark, con, QUERIES[name], SQL[name], SF) == ""
    else:
        assert QUERIES[name](spark, SF).count() >= 0


def test_chain_linked_has_every_bar(spark):
    from tidemark.plans.base import bars

    got = QUERIES["chain_linked"](spark, SF).select("ticker", "date")
    want = bars(spark, SF).select("ticker", "date")
    assert got.count() == want.count() and want.exceptAll(got).isEmpty()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
