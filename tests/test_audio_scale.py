"""audio_pad_truncate against its SQL, where a product in 32 bits ends on a half and one in 64 bits doesn't, and where frames are missing."""

import duckdb

from tests.test_catalog import sorted_rows
from tidemill.plans import catalog

ROWS = [[0.27250000834465027], [-0.13349999487400055, 0.5], [0.2045000046491623] * 120, [], None, [None, 0.25], [None] * 120, [0.0005, -0.0015]]


def test_scaled_in_32_bits(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ROWS)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found, wanted = catalog.queries()["audio_pad_truncate"](spark, str(tmp_path)), con.sql(catalog.oracle_sql()["audio_pad_truncate"])
    assert sorted_rows(found.columns, found.collect()) == sorted_rows(wanted.columns, wanted.fetchall())
