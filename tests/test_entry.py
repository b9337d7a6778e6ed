"""The driver contract: every query runs, and equals its SQL where it has one."""

import duckdb
import pytest

import __spark_entry__ as contract
from longpath.plans import queries

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and set(queries.queries()) <= set(contract.queries())


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"slot_rank"}))
def test_query(spark, db, name):
    got = contract.queries()[name](spark, DATA)
    rows = sorted((tuple(r[c] for c in sorted(got.columns)) for r in got.collect()), key=repr)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = db.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    at = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
