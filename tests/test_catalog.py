"""Every catalogue query against its SQL, on the smallest tables."""

import pytest

from taproot import catalog, catalog_modules, catalog_projects, catalog_reports  # noqa: F401  they register their queries
from taproot.registry import QUERIES, SQL
from tests.compare import difference
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        assert difference(df, SMALL, SQL[name]) == ""
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
