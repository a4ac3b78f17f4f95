"""Queries over packed documents, against their SQL, where some documents have no characters."""

import duckdb
import pytest

from tests.test_catalog import sorted_rows
from tidemill.operators import packing
from tidemill.plans import catalog, delivery  # noqa: F401 - delivery registers its queries


@pytest.fixture(scope="module")
def some_empty(small, tmp_path_factory):
    where = tmp_path_factory.mktemp("empty")
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN doc_id % 50 IN (0, 7) THEN '' ELSE text END AS text) FROM '{small}/documents.parquet') TO '{where}/documents.parquet' (FORMAT parquet)")
    return str(where)


@pytest.mark.parametrize("name", ["pack_plan", "payload_digests", "ranged_bytes"])
def test_empty_documents(spark, some_empty, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{some_empty}/documents.parquet'")
    found, wanted = catalog.queries()[name](spark, some_empty), con.sql(catalog.oracle_sql()[name])
    assert sorted_rows(found.columns, found.collect()) == sorted_rows(wanted.columns, wanted.fetchall())


def test_a_path_is_one_objects(spark, tmp_path):
    twice = spark.createDataFrame([("a", b"x"), ("b", b"12"), ("b", b"345")], "path string, payload binary")
    with pytest.raises(Exception, match="two objects have one path: b"):
        packing.pack(twice, str(tmp_path / "out"), 1, "none")
