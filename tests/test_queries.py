import pytest
from conftest import SMALL, same_rows

from plumbline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, oracle, name):
    same_rows(catalogue.QUERIES[name](spark, SMALL), oracle, catalogue.ORACLE_SQL[name])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["alert_type", "severity", "n"]
