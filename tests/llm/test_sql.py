"""Registered queries that have SQL, against it in DuckDB."""

import duckdb
import pytest

from feedloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    rows = [tuple(r[c] for c in sorted(columns)) for r in found.collect()]
    want = [tuple(dict(zip(columns, r, strict=True))[c] for c in sorted(columns)) for r in result.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_all_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())
