import __spark_entry__
import pytest
from conftest import DATA
from duck import same

from wordloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    same(registry.QUERIES[name](spark, DATA), registry.SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    rows = {r["metric"]: r["value"] for r in __spark_entry__.entry(spark).collect()}
    assert 0.5 < rows["boundary_f1"] <= 1


def test_registered_sql_has_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
