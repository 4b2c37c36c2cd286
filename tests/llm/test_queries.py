"""The registered queries that have SQL, against it."""

import os

import duckdb
import pytest

from quotelake.llm.queries import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = db.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted(tuple(r) for r in got.select(*columns).collect())
    assert rows == sorted(db.sql(f"SELECT {', '.join(columns)} FROM want").fetchall())
