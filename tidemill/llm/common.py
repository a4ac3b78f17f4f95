"""Helpers that the ten operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, found by place: a column whose name differs only in case, or is there twice, is no clash. The first of equal names counts."""
    at = {n: k for k, n in reversed(list(enumerate(df.columns)))}
    low = {n.lower(): k for k, n in reversed(list(enumerate(df.columns)))}
    if gone := [n for n in names if n not in at and n.lower() not in low]:
        raise ValueError(f"no column {', '.join(gone)} among {', '.join(df.columns)}")
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.select(*(F.col(f"c{at.get(n, low.get(n.lower()))}").alias(n) for n in names))


def with_row(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(these columns and `row`, a struct of all columns; a function that makes rows of df again of a table with such a `row`)."""
    fields = [f"c{k}" for k in range(len(df.columns))]
    plain = df.toDF(*fields)
    at = {n: k for k, n in reversed(list(enumerate(df.columns)))}
    low = {n.lower(): k for k, n in reversed(list(enumerate(df.columns)))}
    wide = plain.select(*(F.col(f"c{at[n] if n in at else low[n.lower()]}").alias(f"_{n}") for n in names), F.struct(*fields).alias("row"))
    return wide.toDF(*names, "row"), lambda out: out.select(*(F.col(f"row.{f}").alias(c) for c, f in zip(df.columns, fields, strict=True)))


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, doc_id (long) and text (null text becomes ''); every other column is dropped, whatever its name."""
    narrow = picked(docs, id_col, text_col).toDF("doc_id", "text")
    return narrow.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, stored in the shared checkpoint folder that spark.checkpoint.dir names. Where none is set, one is made, but only for a local master: on a cluster, a folder of one machine would be none for the others."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemill-"))
    return df.checkpoint()


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings end to end, and len+1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = int(off[0]) if len(off) else 0
    return raw[lo : int(off[-1]) if len(off) else 0], off - lo


def mixed64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def give_back() -> None:
    """Hand freed memory back to the system: Python workers outlive their tasks, and executors count what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def pieces(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `most` bytes of text (column 1) each; one row is never divided."""
    _, off = flat_bytes(batch.column(1))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end
    give_back()
