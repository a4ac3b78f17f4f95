"""Embeddings as distinct vectors: what the two operators over vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, mixed64, picked

FEW = 200_000  # rows of a list that is broadcast


def sound(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding: array of float if it was one, else of double): rows with an id and a vector without null, NaN, infinity, and not all zero."""
    raw = picked(embeddings, id_col, vector_col).toDF("vec_id", "embedding")
    kind = "array<float>" if raw.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = raw.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    return rows.filter("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < 1e300D and abs(x) < float('infinity')) and exists(embedding, x -> x <> 0)")


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The sound rows; repeated rows of one id are one vector (the least, in the order of arrays)."""
    return sound(embeddings, id_col, vector_col).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def stored_vectors(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `usable` and `distinct_vectors` give, with vectors stored once and not shuffled: (vec_id, node, n) for each id, and (node, n, embedding, dim) for each distinct vector.

    Only ids and hashes are shuffled to find ids and vectors that repeat. Their list is broadcast up to FEW rows; beyond, vectors are shuffled to meet it.
    """
    rows = cut_lineage(sound(embeddings))
    twice = cut_lineage(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id"))
    if known := twice.count():
        listed = F.broadcast(twice) if known <= FEW else twice
        once = rows.join(listed, "vec_id", "left_anti")
        rows = (once if known <= FEW else cut_lineage(once)).unionByName(cut_lineage(rows.join(listed, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))))
    keyed = rows.select("vec_id", F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), F.col("embedding")).alias("b"))
    classes = keyed.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("vec_id").alias("node")).filter("n > 1")
    copied = cut_lineage(keyed.join(classes, ["a", "b"]).select("vec_id", "node", "n"))
    listed = F.broadcast(copied) if copied.count() <= FEW else copied
    whole = lambda df: df.join(listed, "vec_id", "left").withColumns({"node": F.coalesce("node", "vec_id"), "n": F.coalesce("n", F.lit(1))})
    return whole(rows.select("vec_id")), whole(rows).filter("node = vec_id").select("node", "n", "embedding", F.size("embedding").alias("dim"))


def distinct_vectors(vectors: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Of usable rows: (vec_id, node), and (node, n, ids, embedding) for each distinct vector: its least id, the number of its ids, its `least` least ids.

    Vectors are the same where 128 bits of hash are. Copies leave here: what a third of all rows repeats is counted and cut to a few ids before the shuffle, and is one vector after it.
    """
    keyed = cut_lineage(vectors.withColumn("key", F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), F.col("embedding")).alias("b"))))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("node"), F.min_by("embedding", "vec_id").alias("embedding"))
    if least > 1:
        place = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
        few = keyed.select("key", "vec_id").withColumn("r", place).filter(F.col("r") <= least).groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        counts = counts.join(few, "key")
    else:
        counts = counts.withColumn("ids", F.array("node"))
    nodes = cut_lineage(counts)
    return keyed.join(nodes.select("key", "node"), "key").select("vec_id", "node"), nodes.select("node", "n", "ids", "embedding", F.size("embedding").alias("dim"))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of any float type as unit float64 rows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix, in its own type."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sample_rows(nodes: DataFrame, most: int) -> list:
    """At most `most` nodes (node, embedding), the first by a hash of their id; over all dimensions."""
    return nodes.select("node", "embedding").orderBy(F.xxhash64("node"), "node").limit(most).collect()


def by_dimension(rows: list) -> dict[int, np.ndarray]:
    """The sample as unit rows, by dimension."""
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(len(r["embedding"]), []).append(r["embedding"])
    return {d: unit_rows(np.array(v, np.float64)) for d, v in out.items()}


def block_of(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """A block number under `blocks` for each id, by its hash."""
    return (mixed64(ids.view(np.uint64)) % np.maximum(blocks, 1).astype(np.uint64)).astype(np.int32)
