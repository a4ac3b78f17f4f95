"""Every query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tidemill.plans import catalog, delivery  # noqa: F401 - delivery registers its queries


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_matches_sql(spark, small, tables, name):
    found = catalog.queries()[name](spark, small)
    wanted = tables.sql(catalog.oracle_sql()[name])
    assert sorted_rows(found.columns, found.collect()) == sorted_rows(wanted.columns, wanted.fetchall())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
