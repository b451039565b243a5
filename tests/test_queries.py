"""Each registered query against its DuckDB form, or that it has rows where SQL has none."""

import pytest

from lapwing.plans import catalog_queries, search_queries
from tests.conftest import same_rows

PLANS = catalog_queries.QUERIES | search_queries.QUERIES


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, duck, data, name):
    plan, sql = PLANS[name]
    got = plan(spark, data).toPandas()
    if sql is None:
        assert len(got)
    else:
        same_rows(got, duck.sql(sql).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
