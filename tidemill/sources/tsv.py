"""Manifests as text: two, four, five or more columns with comments, or the canonical five with a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import manifest

SCHEMA = "sample_id long, location string, byte_offset long, byte_length long, decode_hint string"
HEADER = "schema_version=0"


def _fields(lines: DataFrame, good: Column) -> DataFrame:
    p = F.split("value", "\t")
    checked = lines.withColumn("p", F.when(good, p).otherwise(F.raise_error(F.concat(F.lit("a manifest line has a wrong number of columns: "), "value"))))
    text = lambda k: F.nullif(F.get("p", F.lit(k)), F.lit(""))
    return checked.select(F.get("p", F.lit(0)).cast("long").alias("sample_id"), F.get("p", F.lit(1)).alias("location"), text(2).cast("long").alias("byte_offset"), text(3).cast("long").alias("byte_length"), text(4).alias("decode_hint"))


def read_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Sorted by id; ids that aren't 0 .. n-1, each once, or records that aren't good are errors. Columns after the fifth don't count."""
    n = F.size(F.split("value", "\t"))
    rows = _fields(spark.read.text(path).filter("trim(value) <> '' and not startswith(ltrim(value), '#')"), (n == 2) | (n >= 4))
    return manifest.checked(rows).orderBy("sample_id")


def canonical_rows(lines: DataFrame, first: str | None) -> DataFrame:
    """The rows of a canonical text whose first line is `first`."""
    if first != HEADER:
        raise ValueError(f"the first line isn't {HEADER}")
    if lines.filter(F.col("value") == HEADER).count() != 1:
        raise ValueError(f"{HEADER} is there more than once")
    return _fields(lines.filter((F.col("value") != HEADER) & (F.col("value") != "")), F.size(F.split("value", "\t")) == 5)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """As read_lenient, with a header as the first line and exactly five columns."""
    lines = spark.read.text(path)
    first = lines.first()
    return manifest.checked(canonical_rows(lines, first[0] if first else None)).orderBy("sample_id")
