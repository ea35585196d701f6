"""Every registered query against its SQL."""

import pytest

from prefmill.plans import job_queries, registry  # noqa: F401 the first adds its queries to the second
from tests.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE:
        assert differences(df, registry.ORACLE[name], SF) == ""
    else:
        df.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
