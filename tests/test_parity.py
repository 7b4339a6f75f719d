"""Every registered query of the package with SQL gives DuckDB's rows, and some rows."""

import pytest

from rippleset.plans.queries import ORACLES, QUERIES
from tests.parity import both, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    (columns, got), (names, expected) = both(spark, con, QUERIES[name], ORACLES[name], SF)
    assert columns == names
    assert got == expected
    assert got
