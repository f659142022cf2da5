"""Every registered query against its SQL twin, row by row."""

from __future__ import annotations

import math
from datetime import date, datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

# Corpus queries have tests of their own, next to their operators.
CORPUS = contract.corpus()
QUERIES = {name: query for name, query in contract.queries().items() if name not in CORPUS}
ORACLE = {name: sql for name, sql in contract.oracle_sql().items() if name not in CORPUS}


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def _sorted(rows):
    return sorted((tuple(map(_plain, row)) for row in rows), key=repr)


@pytest.fixture(scope="module")
def database(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(name, spark, sf_dir, database):
    got = QUERIES[name](spark, sf_dir)
    expected = database.execute(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(column[0] for column in expected.description)
    order = [[c[0] for c in expected.description].index(column) for column in columns]
    want = [tuple(row[i] for i in order) for row in expected.fetchall()]
    have = [tuple(row) for row in got.select(*columns).collect()]
    assert want, "the oracle found nothing to compare"
    assert _sorted(have) == _sorted(want)
