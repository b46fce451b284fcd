"""Every query of the core with SQL gives the rows that SQL gives."""

import pytest

from quarryset import catalog
from tests.oracle import ROOT, differs

FOLDER = ROOT / "sf0.001"


@pytest.mark.skipif(not FOLDER.exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, name):
    assert differs(spark, name, catalog.QUERIES[name], catalog.SQL[name], str(FOLDER)) is None


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
