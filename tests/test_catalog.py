"""Every query of the catalog against its SQL on the smallest tables."""

import pytest

from keelstone import catalog
from tests.oracle import connect, same_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert name in catalog.SQL
    assert same_rows(df, con, catalog.SQL[name]) is None
