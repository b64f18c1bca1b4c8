"""Every registered query against DuckDB on the smallest data."""

import os

import pytest

from tests.oracle_check import ORACLES, QUERIES, compare, connect

SF = os.environ.get("RANGELOOM_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    state, detail = compare(spark, con, SF, name)
    assert state in ("ok", "rows"), f"{name}: {detail}"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
