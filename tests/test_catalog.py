"""Every named query against the same question in SQL, run by another engine."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry
from conftest import DATA
from spindlewatch.plans import catalog, oracle

QUERIES, SQL = catalog.queries(), oracle.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def other_engine():
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def rows(pdf, columns):
    for c in columns:
        if str(pdf[c].dtype).startswith("datetime"):
            pdf[c] = pdf[c].astype("datetime64[us]")
    clean = pdf[columns].astype(object).where(pdf[columns].notna(), None)
    return sorted(map(str, clean.itertuples(index=False, name=None)))


def test_only_the_random_forest_has_no_sql():
    assert set(QUERIES) - set(SQL) == {"isolation_forest_events"}
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, other_engine, name):
    df = QUERIES[name](spark, DATA)
    relation = other_engine.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    want = dict(zip(relation.columns, map(str, relation.dtypes)))
    assert {c: TYPES[t] for c, t in df.dtypes} == want
    assert rows(df.toPandas(), columns) == rows(relation.df(), columns)


def test_forest_query(spark):
    assert QUERIES["isolation_forest_events"](spark, DATA).count() == 50


def test_entry(spark):
    assert entry(spark).count() == 5
