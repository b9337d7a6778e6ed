"""Registered queries against their SQL, and that each reads and returns its whole table."""

import duckdb
import pytest

from longpath.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, DATA)
    rows = sorted((tuple(r[c] for c in sorted(got.columns)) for r in got.collect()), key=repr)
    sql = queries.oracle_sql().get(name)
    if sql:
        db = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "conversations"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        found = db.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(got.columns)
        at = [columns.index(c) for c in sorted(columns)]
        assert rows == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    elif name.split("_")[0] in ("op2", "op3", "op4", "op6", "op9", "op10", "op13"):
        assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
