"""Document queries that SQL can say, against DuckDB."""

import pytest

from rangeloom.llm import queries
from tests import oracle_check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, monkeypatch, name):
    monkeypatch.setattr(oracle_check, "QUERIES", queries.QUERIES)
    monkeypatch.setattr(oracle_check, "ORACLES", queries.ORACLES)
    state, detail = oracle_check.compare(spark, oracle_check.connect(SF), SF, name)
    assert state == "ok", detail
