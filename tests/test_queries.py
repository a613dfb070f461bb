"""Every registered query against its oracle, or at least to its end."""

import pytest

from revaudit.plans.registry import ORACLE_SQL, QUERIES

from .conftest import SF, same

@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        same(df, duck.sql(ORACLE_SQL[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
