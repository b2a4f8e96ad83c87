"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import pytest

from pricewren.plans import registry
from tests.comparing import database, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, con, name):
    assert not differences(registry.QUERIES[name](spark, SF_DIR), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
