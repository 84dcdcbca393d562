"""Every registered query against its SQL, and the rest for running."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL, TINY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [q for q in entry.queries() if q[0] == "q"]


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name not in entry.oracle_sql():
        return
    want = duck.execute(entry.oracle_sql()[name])
    names, rows = _rows([d[0] for d in want.description], want.fetchall())
    assert columns == names
    assert len(got) == len(rows)
    bad = [(a, b) for a, b in zip(got, rows) if a != b]
    assert not bad, (len(bad), bad[:2])


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and TINY


def test_every_oracle_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
