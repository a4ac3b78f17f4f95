"""Snapshots: a manifest pinned under the hash of its content, and the pointer of each dataset to its current one."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import manifest
from tidemill.plans.lineage import empty_files, stored
from tidemill.sources.links import checked_key, intent_key, parsed
from tidemill.sources.tsv import read_canonical


STALE_S, WAIT_S, POLL_S = 60.0, 30.0, 0.1


class Store:
    """A folder on any file system that Spark reads: by-hash/<hash> holds Parquet sorted by sample_id, intent/<key> the current hash, locks/<key> who indexes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        at, fs = self._fs(path)
        return fs.exists(at)

    def put(self, rows: DataFrame) -> str:
        """The hash of rows. What is whole under this hash stays as it is, and is an error if it has another number of rows; what a writer left half done is written anew."""
        rows = stored(rows.select("sample_id", "location", "byte_offset", "byte_length", "decode_hint"))
        key, n = manifest.content_hash(rows), rows.count()
        path = f"{self.root}/by-hash/{key}"
        if not self._exists(f"{path}/_SUCCESS"):
            rows.repartitionByRange("sample_id").sortWithinPartitions("sample_id").write.mode("overwrite").parquet(path)
        elif (has := self.length(key)) != n:
            raise ValueError(f"{key} is there with {has} rows, not {n}")
        return key

    def get(self, key: str) -> DataFrame:
        path = f"{self.root}/by-hash/{checked_key(key)}"
        if not self._exists(f"{path}/_SUCCESS"):
            raise KeyError(f"no snapshot {key}")
        return self.spark.read.parquet(path)

    def length(self, key: str) -> int:
        return self.get(key).count()

    def part(self, key: str, start: int, end: int) -> DataFrame:
        """The rows start .. end - 1; a range beyond the snapshot is an error, and so are ids that aren't all there."""
        rows = manifest.sliced(self.get(key), start, end, self.length(key))
        if (n := rows.count()) != end - start:
            raise ValueError(f"{n} rows of {end - start}")
        return rows

    def point(self, base: str, key: str) -> None:
        """The pointer is written beside its place and renamed, so a reader sees the old one or the new one."""
        path = f"{self.root}/intent/{intent_key(base)}"
        part, fs = self._fs(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(checked_key(key).encode()))
        out.close()
        at, _ = self._fs(path)
        if fs.exists(at):
            fs.delete(at, False)
        if not fs.rename(part, at):
            raise OSError(f"can't set {path}")

    def current(self, base: str) -> str | None:
        path = f"{self.root}/intent/{intent_key(base)}"
        return self.spark.read.text(path).first()[0] if self._exists(path) else None

    def lock(self, base: str, owner: str) -> bool:
        """Whether the owner may index now: the lock file is new, or older than STALE_S and taken over."""
        at, fs = self._fs(f"{self.root}/locks/{intent_key(base)}")
        for _ in range(2):
            try:
                out = fs.create(at, False)
                out.write(bytearray(owner.encode()))
                out.close()
                return True
            except Exception:  # noqa: BLE001 - the file system says in its own way that it is there
                if not fs.exists(at):
                    raise
                if time.time() - fs.getFileStatus(at).getModificationTime() / 1000 < STALE_S:
                    return False
                fs.delete(at, False)
        return False

    def unlock(self, base: str) -> None:
        at, fs = self._fs(f"{self.root}/locks/{intent_key(base)}")
        fs.delete(at, False)

    def resolve(self, link: str, index: Callable[[str], DataFrame], owner: str = "driver", wait: float = WAIT_S) -> tuple[str, DataFrame]:
        """(hash, manifest): a pinned link by its hash, another by the current pointer; index makes the manifest where there is none or it is to be made anew.

        Of several that would index one does; the others wait for its pointer, and after `wait` seconds it is an error.
        """
        to = parsed(link)
        if to.pinned:
            return to.pinned, self.get(to.pinned)
        before = self.current(to.base)
        if before and not to.refresh:
            return before, self.get(before)
        if self.lock(to.base, owner):
            try:
                key = self.put(index(to.base))
                self.point(to.base, key)
            finally:
                self.unlock(to.base)
            return key, self.get(key)
        until = time.time() + wait
        while time.time() < until:
            now = self.current(to.base)
            if now and (now != before or not self._exists(f"{self.root}/locks/{intent_key(to.base)}")):
                return now, self.get(now)
            time.sleep(POLL_S)
        raise TimeoutError(f"nobody has indexed {to.base} in {wait} s")


def folder(spark: SparkSession, base: str, recursive: bool = True, labels: str = "none") -> DataFrame:
    """The manifest of the files under a folder, by path, with their lengths (none for an empty file). Where a folder has been packed, it is the packed manifest; own metadata and shards right below the folder are no samples; a folder without a file is an error."""
    root = re.sub("^file:(//)?", "", base).rstrip("/")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/_meta/manifest.tsv")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return read_canonical(spark, f"{base.rstrip('/')}/_meta/manifest.tsv")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(base).select(F.col("path").alias("location"), F.col("length").alias("byte_length"))
    if empty := empty_files(spark, base, recursive):
        files = files.unionByName(spark.createDataFrame([(p, None) for p in empty], "location string, byte_length long"))
    inner = F.expr(f"substring(regexp_replace(location, '^file:(//)?', ''), {len(root) + 2})")
    kept = files.withColumn("inner", inner).filter(~F.col("inner").rlike("^(_meta|shards)(/|$)"))
    ids = manifest.with_dense_ids(kept, "location")
    if ids.isEmpty():
        raise ValueError(f"no file below {base}")
    named = manifest.labelled(ids, F.col("inner"), labels)
    return named.select("sample_id", "location", F.when(F.col("byte_length").isNotNull(), 0).cast("long").alias("byte_offset"), "byte_length", manifest.label_hint(F.col("label_id"), F.col("label")).alias("decode_hint"))


def synthetic(spark: SparkSession, n: int, size: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("sample_id"), F.encode(F.repeat(F.lit("x"), size), "UTF-8").alias("payload"))
