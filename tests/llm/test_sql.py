"""Queries against their SQL."""

import duckdb
import pytest

from tests.conftest import SMALL
from tidegauge.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    rows = sorted(tuple(sorted(zip(columns, r))) for r in want.fetchall())
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns) and rows
    assert sorted(tuple(sorted(r.asDict().items())) for r in got.collect()) == rows
