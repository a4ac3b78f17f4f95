"""Batches: fixed counts, byte-aware greedy batches, offsets, size jitter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

JITTER_WINDOW = 128


def fixed(rows: DataFrame, size: int, key: str = "sample_id") -> DataFrame:
    """(batch_id, first_id, last_id, n, bytes) for dense ids; bytes is null for a batch with a sample of unknown length."""
    known = F.when(F.count("byte_length") == F.count("*"), F.sum("byte_length"))
    return rows.groupBy(F.expr(f"{key} div {size}").alias("batch_id")).agg(F.min(key).alias("first_id"), F.max(key).alias("last_id"), F.count("*").alias("n"), known.alias("bytes"))


def band(target: int, most: int, lower: int = 85, upper: int = 115) -> tuple[int, int]:
    clip = lambda x: min(max(-(-x // 100), 1), most)
    return clip(target * lower), clip(target * upper)


def default_caps(inflight: int) -> tuple[int, int]:
    """(max, target) bytes of a batch under an inflight limit."""
    most = min(max(inflight // 4, 4 << 20), 64 << 20, inflight)
    return most, -(-most * 9 // 10)


def cutter(most_rows: int, target: int, most: int, lower: int = 85, upper: int = 115) -> Callable[[np.ndarray], np.ndarray]:
    """A function from lengths to batch numbers."""
    low, high = band(target, most, lower, upper)

    def numbers(lengths: np.ndarray) -> np.ndarray:
        out, batch, count, size = np.empty(len(lengths), np.int64), 0, 0, 0
        for k, n in enumerate(lengths.tolist()):
            if n is None or n != n:
                raise ValueError("byte-aware batches need the length of every sample")
            if n > most:
                raise ValueError(f"a sample of {n} bytes exceeds the batch limit of {most}")
            full = count >= most_rows or size >= target
            if count and (full or size + n > most or (size >= low and size + n > high)):
                batch, count, size = batch + 1, 0, 0
            out[k], count, size = batch, count + 1, size + n
        return out

    return numbers


def by_bytes(rows: DataFrame, by: str, most_rows: int, target: int, most: int, inflight: int | None = None) -> DataFrame:
    """(by, batch_no, first_id, last_id, n, bytes): the greedy cut is a fold, so it runs in each work range by itself, all ranges at once; only ids and lengths move."""
    if inflight is not None and most > inflight:
        raise ValueError(f"a batch of {most} bytes wouldn't fit into the {inflight} that may be in flight")
    numbers = cutter(most_rows, target, most)

    def cut(group: pa.Table) -> pa.Table:
        t = group.sort_by("sample_id")
        if t["byte_length"].null_count:
            raise ValueError("byte-aware batches need the length of every sample")
        return t.append_column("batch_no", pa.array(numbers(t["byte_length"].to_numpy())))

    placed = rows.select(by, "sample_id", "byte_length").groupBy(by).applyInArrow(cut, f"{by} long, sample_id long, byte_length long, batch_no long")
    return placed.groupBy(by, "batch_no").agg(F.min("sample_id").alias("first_id"), F.max("sample_id").alias("last_id"), F.count("*").alias("n"), F.sum("byte_length").alias("bytes"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(batch_id, sample_ids, offsets): the ragged layout; offsets start at 0 and end at the payload's length. A sample of unknown length is an error."""
    length = F.when(F.col("byte_length").isNull(), F.raise_error(F.concat(F.lit("a sample of unknown length: "), F.col("sample_id").cast("string"))).cast("long")).otherwise(F.col("byte_length"))
    grouped = rows.groupBy(F.expr(f"sample_id div {size}").alias("batch_id")).agg(F.sort_array(F.collect_list(F.struct("sample_id", length.alias("byte_length")))).alias("x"))
    running = F.aggregate("x", F.array(F.lit(0).cast("long")), lambda a, r: F.concat(a, F.array(F.element_at(a, -1) + r["byte_length"])))
    return grouped.select("batch_id", F.col("x.sample_id").alias("sample_ids"), running.alias("offsets"))


BATCH = "batch_id long, sample_ids array<long>, offsets array<long>, payload binary, label_ids array<long>"


def with_payload(rows: DataFrame, by: str = "batch_id") -> DataFrame:
    """BATCH from (by, sample_id, payload, label_id): samples in order of their ids, their bytes end to end; label_ids null where no sample has one, an error where some have.

    A batch is what a task holds, so batches are to be cut by bytes or counts first.
    """

    def joined(group: pa.Table) -> pa.Table:
        t = group.sort_by("sample_id").combine_chunks()
        labels, data = t["label_id"], t["payload"].to_pylist()
        if any(x is None for x in data):
            raise ValueError(f"a sample of batch {t[by][0].as_py()} has no payload")
        if 0 < labels.null_count < len(t):
            raise ValueError(f"some samples of batch {t[by][0].as_py()} have no label")
        return pa.table([[t[by][0].as_py()], [t["sample_id"].to_pylist()], [np.cumsum([0, *map(len, data)]).tolist()], [b"".join(data)], [None if labels.null_count else labels.to_pylist()]], schema=pa.schema([("batch_id", pa.int64()), ("sample_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary()), ("label_ids", pa.list_(pa.int64()))]))

    return rows.select(by, "sample_id", "payload", F.col("label_id").cast("long").alias("label_id")).groupBy(by).applyInArrow(joined, BATCH)


def within_inflight(batches: DataFrame, cap: int) -> DataFrame:
    """batches, with an error for one that needs more 1 KiB permits than there are."""
    over = F.ceil(F.col("bytes") / F.lit(1024.0)) > cap // 1024
    return batches.withColumn("bytes", F.when(over, F.raise_error(F.concat(F.lit("a batch is larger than what may be in flight: "), F.col("bytes").cast("string"))).cast("long")).otherwise(F.col("bytes")))


def in_order(batches: DataFrame, order: str = "batch_id") -> Iterator:
    """The batches one after the other in order, with the next partition fetched while this one is used."""
    yield from batches.orderBy(order).toLocalIterator(prefetchPartitions=True)


def tensors(batches: DataFrame, columns: list[str], order: str = "batch_id") -> Iterator[dict[str, np.ndarray]]:
    """Each batch's columns as arrays, in order: what a training loop takes."""
    for row in in_order(batches.select(order, *columns), order):
        yield {c: np.frombuffer(row[c], np.uint8) if isinstance(row[c], bytes | bytearray) else np.array(row[c]) for c in columns}


BREACH, RELAX, COOLDOWN, SPREAD = 1250, 1100, 16, 10


def guarded_bands(sizes: DataFrame, by: str, order: str, lower: int = 85, upper: int = 115, width: int = JITTER_WINDOW) -> DataFrame:
    """(by, order, ratio_milli, lower, upper): the band after each batch, as a controller sets it.

    Once the window is full, a ratio over BREACH narrows the band by 2 on each side (lower to 95 at most, SPREAD apart), one under RELAX widens it by 1
    towards where it began; after a change it rests for COOLDOWN batches. Each stream is a fold of its own.
    """

    def fold(group: pa.Table) -> pa.Table:
        t = group.sort_by(order)
        lo, hi, rest, out = lower, upper, 0, []
        for k, ratio in enumerate(t["ratio_milli"].to_pylist()):
            if k + 1 >= width:
                if rest:
                    rest -= 1
                else:
                    new = (lo, hi)
                    if ratio > BREACH:
                        low = min(lo + 2, 95)
                        new = (low, min(max(hi - 2, low + SPREAD), upper))
                    elif ratio < RELAX:
                        low = max(lo - 1, lower)
                        new = (low, max(min(hi + 1, upper), low + SPREAD))
                    if new != (lo, hi):
                        (lo, hi), rest = new, COOLDOWN
            out.append((lo, hi))
        return pa.table([t[by], t[order], t["ratio_milli"], pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.int32())], names=[by, order, "ratio_milli", "lower", "upper"])

    seen = jitter(sizes, by, order, width).select(F.col(by).cast("long").alias(by), F.col(order).cast("long").alias(order), "ratio_milli")
    return seen.groupBy(by).applyInArrow(fold, f"{by} long, {order} long, ratio_milli long, lower int, upper int")


def jitter(batches: DataFrame, by: str, order: str, width: int = JITTER_WINDOW) -> DataFrame:
    """batches with p50, p95 and ratio_milli over the last `width` sizes of their stream."""
    last = F.sort_array(F.collect_list("bytes").over(Window.partitionBy(by).orderBy(order).rowsBetween(1 - width, 0)))
    seen = batches.withColumn("w", last)
    at = lambda q: F.element_at("w", (F.floor((F.size("w") - 1) * q / 100) + 1).cast("int"))
    return seen.select(*batches.columns, at(50).alias("p50"), at(95).alias("p95")).withColumn("ratio_milli", F.when(F.col("p50") > 0, F.floor((F.col("p95") * 1000 + F.floor(F.col("p50") / 2)) / F.col("p50"))).otherwise(0).cast("long"))


def cursors(batches: DataFrame, by: str, order: str) -> DataFrame:
    """The delivery cursor after each batch: one past the greatest id so far."""
    return batches.withColumn("cursor", F.max("last_id").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) + 1)
