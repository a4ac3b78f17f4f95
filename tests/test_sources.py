"""Links, snapshots, text manifests and progress streams."""

import pytest
from pyspark.sql import functions as F

from tidemill.sources import links, snapshot, tsv
from tidemill.streaming import progress


def test_links():
    assert links.parsed("s3://b/p/") == links.Link("s3://b/p/")
    assert links.parsed("s3://b/p@refresh") == links.Link("s3://b/p", refresh=True)
    assert links.parsed("u@h/p@sha256:abc") == links.Link("u@h/p", pinned="abc")
    assert links.parsed("s3://b/p@v2") == links.Link("s3://b/p@v2")
    assert links.intent_key("a/b/ ") == links.intent_key("a/b")
    for bad in ("", " ", "../x", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            links.checked_key(bad)
    with pytest.raises(ValueError):
        links.parsed("x@sha256:")


def test_snapshots_are_pinned(spark, tmp_path):
    data = tmp_path / "data"
    for name in ("b/2.txt", "a/1.txt", "shards/x.tar", "_meta/m"):
        (data / name).parent.mkdir(parents=True, exist_ok=True)
        (data / name).write_text(name)
    store, index = snapshot.Store(spark, str(tmp_path / "store")), lambda base: snapshot.folder(spark, base)
    key, rows = store.resolve(str(data), index)
    assert [(r["sample_id"], r["location"][-7:], r["byte_length"]) for r in rows.orderBy("sample_id").collect()] == [(0, "a/1.txt", 7), (1, "b/2.txt", 7)]
    (data / "c.txt").write_text("new")
    assert store.resolve(str(data), index)[0] == key
    newer, rows = store.resolve(f"{data}@refresh", index)
    assert newer != key and rows.count() == 3 and store.resolve(str(data), index)[0] == newer
    assert store.resolve(f"{data}@sha256:{key}", index)[1].count() == 2


def test_text_manifests(spark, tmp_path):
    (tmp_path / "dev.tsv").write_text("# note\n0\tx.bin\n1\ty.bin\t64\t64\n2\tz.bin\t0\t9\thint\n")
    assert [tuple(r) for r in tsv.read_lenient(spark, str(tmp_path / "dev.tsv")).orderBy("sample_id").collect()] == [(0, "x.bin", None, None, None), (1, "y.bin", 64, 64, None), (2, "z.bin", 0, 9, "hint")]
    (tmp_path / "bad.tsv").write_text("0\tx\t1\n")
    with pytest.raises(Exception, match="wrong number of columns"):
        tsv.read_lenient(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "m.tsv").write_text("schema_version=0\n0\tx\t\t\t\n")
    assert [tuple(r) for r in tsv.read_canonical(spark, str(tmp_path / "m.tsv")).collect()] == [(0, "x", None, None, None)]
    with pytest.raises(ValueError):
        tsv.read_canonical(spark, str(tmp_path / "bad.tsv"))


def test_progress_streams(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    reports = lambda df: df.selectExpr("user_id % 50 AS lease_id", "user_id % 4 AS node", "user_id % 4 AS owner", "0 AS start_id", "1000 AS end_id", "event_id * 7919 % 1100 AS cursor")
    q = progress.cursors(reports(stream)).writeStream.outputMode("complete").format("memory").queryName("cursors").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = progress.cursors(reports(events))
    assert sorted(map(tuple, spark.table("cursors").collect())) == sorted(map(tuple, want.collect()))
    seen = []
    progress.deliver(stream.select(F.col("event_id")), lambda df, epoch: seen.append(df.count()), str(tmp_path / "ck2")).awaitTermination(120)
    assert sum(seen) == events.count()
