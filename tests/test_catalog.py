import pytest

from lattix import catalog, catalog_growth, catalog_landscape  # noqa: F401
from tests.compare import assert_same


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_against_sql(spark, sf, name):
    assert_same(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_gives_rows(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)
