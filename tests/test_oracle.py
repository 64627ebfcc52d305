"""Every registered query against its oracle SQL in DuckDB."""

import math

import duckdb
import pytest

from feedloom.plans import catalog
from tests.conftest import SF

TABLES = "events documents pages benchmark labels".split()
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return int(value) if isinstance(value, bool) else value


def ordered(columns, names, rows):
    places = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in places) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    assert ordered(columns, df.columns, df.collect()) == ordered(columns, names, found.fetchall())


def test_every_query_has_a_column_list(spark):
    assert set(ORACLE) <= set(catalog.queries())
    assert set(catalog.queries()) == set(ORACLE)
