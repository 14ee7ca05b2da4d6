import pytest

from lodestar.plans import basics, stateful

from .conftest import SF
from .oracle import rows_of_frame, rows_of_sql


@pytest.mark.parametrize("name", sorted(basics.SQL | stateful.SQL))
def test_query_equals_its_sql(spark, name):
    query, sql = (basics.QUERIES | stateful.QUERIES)[name], (basics.SQL | stateful.SQL)[name]
    assert rows_of_frame(query(spark, SF)) == rows_of_sql(sql, SF)


def test_entry_runs(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.count() == 5 and "rho" in got.columns
