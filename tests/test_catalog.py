"""Every query of the catalogue runs, and equals its SQL on DuckDB where it has one."""

import parity
import pytest

from wardline import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return parity.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    if name in catalog.ORACLES:
        assert parity.compare(spark, db, SF, catalog.QUERIES[name], catalog.ORACLES[name]) == ""
    else:
        df = catalog.QUERIES[name](spark, SF)
        assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
