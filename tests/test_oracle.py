"""Every query of the library proper against its SQL, over whole tables."""

import datetime as dt
import os

import duckdb
import pandas as pd
import pytest

from quotelake import registry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in sorted(os.listdir(FOLDER)):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return None
    if isinstance(x, bool | str):
        return str(x)
    if isinstance(x, dt.date):
        return str(pd.Timestamp(x))
    return round(float(x), 6)


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


#: Queries that SQL doesn't express; these files hold brute-force versions of their operators.
OWN_TESTS = {"ordered_coverage": "test_text", "hashed_search": "test_search", "typed_search": "test_search", "close_words": "test_search", "live_reading": "test_live", "reading_positions": "test_live", "utterance_decisions": "test_engine", "live_utterances": "test_timed"}


def test_every_query_has_sql_or_a_test():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL) | set(OWN_TESTS)
    assert all(os.path.exists(os.path.join(os.path.dirname(__file__), f"{t}.py")) for t in OWN_TESTS.values())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, FOLDER)
    assert len(set(got.columns)) == len(got.columns)
    want = db.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.toPandas()), rows(want)
    assert len(a) == len(b)
    assert a == b
