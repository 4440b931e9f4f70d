"""Every registered query of the package against its oracle SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from lodestone.plans import answering, conversation, figures, layout, retrieval, storage  # noqa: F401
from lodestone.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def rows(frame, columns):
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return str(v)
        return f"{float(v):.9g}"

    return sorted(tuple(map(str, map(cell, r))) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, con, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert len(ours) and rows(ours, columns) == rows(theirs, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf, name):
    assert not QUERIES[name](spark, sf).isEmpty()


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
