"""Every query with a DuckDB twin, on the smallest tables; every other query runs."""

import pytest

from quillspark.plans import catalog
from tests.oracle import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_duckdb(spark, con, name):
    assert differences(spark, name, catalog.QUERIES[name], catalog.ORACLE[name], SF, con) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).collect()
