"""Every core query runs on the smallest tables and gives the rows of its SQL."""

import pytest
from oracle import rows, tables

from tidewell.plans import registry

FOLDER = "/root/testdata/sf0.001"
BASE = tables(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    found = registry.queries()[name](spark, FOLDER).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(found.columns) > 0
    else:
        assert rows(found) == rows(BASE.execute(sql).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
