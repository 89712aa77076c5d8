import pytest

from oracle import check
from pagequern.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, base, name):
    check(spark, base, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, base, name):
    df = catalog.QUERIES[name](spark, base)
    assert df.columns
    assert df.count() >= 0
