import pytest

from conftest import same_rows
from weftline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(name, spark, small, duck):
    same_rows(registry.QUERIES[name](spark, small), duck, registry.ORACLES[name])


def test_every_query_without_sql_is_known():
    assert set(registry.QUERIES) - set(registry.ORACLES) == set()


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
