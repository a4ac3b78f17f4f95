"""Operator 1, substring dedup: content-defined chunking with a gear rolling hash; chunks are deduplicated by digest.

A gear hash of the last 16 bytes decides the cuts, so a cut depends on nearby bytes only and an insertion moves no cut but its
neighbours. A chunk that occurs more than once in the corpus is repeated; consecutive repeated chunks of a document make a span, and
a span of `min_span` bytes or more is reported for every document that holds it, the first holder included. What to keep is decided by
chunk: `passages`, the operator, divides a span where the first holder or keep changes, and a part is reported however short it is, so
that without the parts not to be kept each chunk of the corpus is still there once.

Defined results: null or empty texts, and rows whose doc_id is null, give no row; repeated rows are occurrences like any other (a
text given twice is repeated) and fold into one span of their doc_id, and so do different texts of one doc_id, whose chunks count as one text's; very long texts are chunked whole, a
task holds one at a time; of equal chunks the one in the least doc_id, and there the first, is kept; an empty table gives an empty result; extra columns are ignored, also those whose
names differ from a needed one's in case alone.
The digest has 64 bits; for a span of two or more chunks to be wrong, all its digests would have to collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, flat_bytes, keyed_texts, mixed64, pieces

GEAR = (mixed64(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
WINDOW = 16
MIN_CHUNK, MAX_CHUNK, MASK_BITS, MIN_SPAN = 16, 1024, 4, 96
LEN_BITS = 12
AGAIN = 1 << 11  # of these bits: the text has had the chunk before
CHUNKS = pa.schema([("digest", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 2) + GEAR[byte i] modulo 2**32, for all i at once: what is older than 16 bytes has been shifted out."""
    h = GEAR[data]
    step = 1
    with np.errstate(over="ignore"):
        while step < WINDOW:
            h[step:] += h[:-step] << np.uint32(2 * step)
            step *= 2
    return h


def cuts(data: np.ndarray, offsets: np.ndarray, mask_bits: int = MASK_BITS, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Iterator[tuple[int, list[int]]]:
    """For each text of more than no bytes: its number, and the ends of its chunks, counted in the whole buffer."""
    if not len(data):
        return
    ok = (gear_hash(data) >> np.uint32(32 - mask_bits)) == 0
    ok[:-1] &= (data[1:] & 0xC0) != 0x80
    at = np.flatnonzero(ok) + 1
    bounds = np.searchsorted(at, offsets)
    at = at.tolist()
    for k, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if lo == hi:
            continue
        ends, last, first = [], lo, lo + WINDOW
        for p in [*at[bounds[k] : bounds[k + 1]], hi]:
            while p - last > max_chunk:
                q = last + max_chunk
                while q > last + max_chunk - 4 and data[q] & 0xC0 == 0x80:
                    q -= 1
                ends.append(q)
                last = q
            if (p - last >= min_chunk and p >= first) or p == hi:
                if p > last:
                    ends.append(p)
                last = p
        yield k, ends


def chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest_of = xxhash.xxh3_64_intdigest
    for whole in batches:
        for batch in pieces(whole):
            data, offsets = flat_bytes(batch.column(1))
            ids, view = batch.column(0).to_pylist(), memoryview(data)
            digest, start, end, doc, count = [], [], [], [], []
            for k, ends in cuts(data, offsets):
                begin = [int(offsets[k]), *ends[:-1]]
                digest += [digest_of(view[a:b]) for a, b in zip(begin, ends, strict=True)]
                start += begin
                end += ends
                doc.append(k)
                count.append(len(ends))
            if digest:
                s, row = np.array(start), np.repeat(np.array(doc), np.array(count))
                keys = np.array(digest, dtype=np.uint64).view(np.int64)
                order, again = np.lexsort((keys, row)), np.zeros(len(s), np.int64)  # stable, so the first in the text comes first
                again[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
                place = ((s - offsets[row]) << LEN_BITS) | (again * AGAIN) | (np.array(end) - s)
                yield batch_of(CHUNKS, keys, np.array(ids, dtype=np.int64)[row], place)


def chunks(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, place): place holds the chunk's first byte and, in its last 12 bits, AGAIN and its length."""
    return keyed_texts(docs).filter("doc_id is not null and text <> ''").mapInArrow(chunk_batches, "digest long, doc_id long, place long")


def spans_of(pieces_: DataFrame, extra: list, min_span: int) -> DataFrame:
    """Overlapping or touching (doc_id, start_byte, end_byte) made one; extra: aggregates over what a span is made of."""
    by = Window.partitionBy("doc_id").orderBy("start_byte", "end_byte")
    before = F.max("end_byte").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = pieces_.withColumn("opens", F.when(F.col("start_byte") <= before, 0).otherwise(1))
    return (
        opens.withColumn("span", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "span")
        .agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), *extra)
        .drop("span")
        .filter(F.col("end_byte") - F.col("start_byte") >= min_span)
    )


def parts_of(marked: DataFrame, extra: list, min_span: int, text: list[str] | None = None) -> DataFrame:
    """The spans of spans_of, each divided where first or keep changes: a row for each part. text: the columns that tell texts apart."""
    text = text or ["doc_id"]
    by = Window.partitionBy(*text).orderBy("start_byte", "end_byte")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("start_byte") > F.max("end_byte").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    turns = F.col("opens") | (F.lag("first").over(by) != F.col("first")) | (F.lag("keep").over(by) != F.col("keep"))
    parts = (
        marked.withColumn("opens", opens)
        .withColumn("turns", turns)
        .withColumns({"span": F.sum(F.col("opens").cast("int")).over(so_far), "part": F.sum(F.col("turns").cast("int")).over(so_far)})
        .groupBy(*text, "span", "part")
        .agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), *extra, F.first("first").alias("first_doc_id"), F.first("keep").alias("keep"))
    )
    whole = Window.partitionBy(*text, "span")
    return parts.withColumn("bytes", F.max("end_byte").over(whole) - F.min("start_byte").over(whole)).filter(F.col("bytes") >= min_span).drop("span", "part", "bytes")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, start_byte, end_byte, n, first, keep): every occurrence of a repeated chunk; keep is true of the first one.

    Chunks are counted with map-side combining, so a passage that millions of documents hold is no hot key there; the join back is left
    to AQE's skew handling. What is unique, most of a corpus, leaves at that join.
    """
    all_chunks = chunks(docs)
    repeated = all_chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")
    start, bits = F.shiftright("place", LEN_BITS), F.col("place")
    keep = (F.col("first") == F.col("doc_id")) & (bits.bitwiseAND(AGAIN) == 0)
    return all_chunks.join(repeated, "digest").select("doc_id", start.alias("start_byte"), (start + bits.bitwiseAND(AGAIN - 1)).alias("end_byte"), "n", "first", keep.alias("keep"))


def passages(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """(doc_id, start_byte, end_byte, n_chunks, n_copies, first_doc_id, keep): the parts of repeated spans; bytes count in UTF-8.

    first_doc_id is the least doc_id that holds the part's chunks, and keep says whether this is their first occurrence there.
    """
    return parts_of(repeated_chunks(docs), [F.count("*").alias("n_chunks"), F.max("n").alias("n_copies")], min_span).select("doc_id", "start_byte", "end_byte", "n_chunks", "n_copies", "first_doc_id", "keep")


def substring_dedup(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """(doc_id, start_byte, end_byte, n_chunks, n_copies, first_doc_id, keep): the repeated spans, undivided.

    first_doc_id is the least doc_id that holds any of the span's chunks and keep says whether it is this one: not what to delete by,
    for a span may have chunks of several first holders (see `passages`).
    """
    found = spans_of(repeated_chunks(docs), [F.count("*").alias("n_chunks"), F.max("n").alias("n_copies"), F.min("first").alias("first_doc_id")], min_span)
    return found.withColumn("keep", F.col("first_doc_id") == F.col("doc_id"))
