"""Every query of the catalogue against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from threadloom import catalogue

TABLES = "documents embeddings pages benchmark labels conversations events orders".split()


def form(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return value


@pytest.fixture(scope="module")
def engine(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, engine, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted((tuple(form(r[c]) for c in columns) for r in got.collect()), key=repr)
    if name not in catalogue.SQL:
        assert got.columns
        return
    result = engine.sql(catalogue.SQL[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    assert rows == sorted((tuple(form(r[i]) for i in places) for r in result.fetchall()), key=repr)
