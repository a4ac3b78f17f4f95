"""Samples' bytes: whole objects and ranges of them, read where they lie, with retries."""

from __future__ import annotations

import os
import random
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import manifest

SPAN = 256 << 20  # of one object, read by one task
OUT = 16 << 20  # of payload in one batch to Spark
Reader = Callable[[str, int | None, int | None], bytes]


class Passing(OSError):
    """A failure that may pass: a timeout, a lost connection, an answer of 408, 429 or 5xx."""


def passing(status: int) -> bool:
    return status in (408, 429) or 500 <= status <= 599


def delay(attempt: int, sample_id: int = 0) -> float:
    """Seconds before try number attempt + 1: doubling from 50 ms to a second, with a jitter that follows from the id."""
    return min(1.0, 0.05 * 2**attempt) + sample_id % 37 / 1000


def retried(f: Callable[[], bytes], attempts: int = 3, sample_id: int = 0, sleep: Callable[[float], None] = time.sleep) -> bytes:
    for k in range(attempts):
        try:
            return f()
        except Passing:
            if k + 1 == attempts:
                raise
            sleep(delay(k, sample_id))
    raise ValueError("one attempt or more")


def local_reader(location: str, offset: int | None, length: int | None) -> bytes:
    """A file on a path that the machine sees; without a range all of it, up to the length that it has when it is opened."""
    with open(re.sub("^file:(//)?", "", location), "rb") as f:
        if offset is None:
            size = os.fstat(f.fileno()).st_size
            data = f.read(size)
            if f.read(1) or len(data) != size:
                raise ValueError(f"{location} changed while it was read")
            return data
        f.seek(offset)
        data = f.read(length)
        if len(data) != length:
            raise ValueError(f"{location} ends {length - len(data)} bytes before {offset + length}")
        return data


def whole_of(location: str, data: bytes) -> bytes:
    """An object of another store is never empty."""
    if not data:
        raise ValueError(f"{location} is empty")
    return data


READERS: dict[str, Reader] = {"file": local_reader}


def one_read(known: dict[str, Reader], attempts: int, sample_id: int, scheme: str, location: str, offset: int | None, length: int | None) -> bytes:
    if scheme not in known:
        raise ValueError(f"no reader for {scheme}: {location}")
    if (offset is None) != (length is None):
        raise ValueError(f"offset and length come together: sample {sample_id}")
    data = retried(lambda: known[scheme](location, offset, length), attempts, sample_id)
    return data if scheme == "file" or offset is not None else whole_of(location, data)


def with_bytes(rows: DataFrame, readers: dict[str, Reader] | None = None, attempts: int = 3) -> DataFrame:
    """rows (sample_id, location, byte_offset, byte_length, ..) with payload.

    Reads of one object go to tasks by SPAN bytes, each in order of its offsets, so neighbours are read one after the other and an object that
    holds a third of all samples is many tasks. readers: by scheme, for stores beyond the file system; a scheme without one is an error.
    """
    known = dict(READERS) | (readers or {})
    spread = rows.withColumn("_scheme", manifest.scheme(F.col("location"))).repartition(F.xxhash64("location", F.expr(f"coalesce(byte_offset, 0) div {SPAN}"))).sortWithinPartitions("location", "byte_offset", "sample_id")
    names = rows.columns
    at = {n: names.index(n) for n in ("sample_id", "location", "byte_offset", "byte_length")}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(at[n]).to_pylist() for n in ("sample_id", "location", "byte_offset", "byte_length")]
            start, held, data = 0, 0, []
            for k, (i, location, offset, length) in enumerate(zip(*columns, strict=True)):
                data.append(one_read(known, attempts, i, b.column(len(names))[k].as_py(), location, offset, length))
                held += len(data[-1])
                if held >= OUT:
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, len(data)) for c in b.columns[:-1]), pa.array(data, pa.binary())], names=[*names, "payload"])
                    start, held, data = k + 1, 0, []
            if data:
                yield pa.RecordBatch.from_arrays([*(c.slice(start, len(data)) for c in b.columns[:-1]), pa.array(data, pa.binary())], names=[*names, "payload"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return spread.select(*names, "_scheme").mapInArrow(read, f"{fields}, payload binary")


def header_range(offset: int, length: int) -> str:
    """A half-open range as the header that asks for it, whose end is inclusive."""
    if length <= 0:
        raise ValueError("a range has a byte or more")
    return f"bytes={offset}-{offset + length - 1}"


def with_ranges(plans: DataFrame, readers: dict[str, Reader] | None = None, attempts: int = 3) -> DataFrame:
    """(plan_id, payload) from (plan_id, location, part, byte_offset, byte_length): the half-open ranges of each plan, end to end in order of part.

    The plans are shuffled, not the bytes: one task reads all ranges of a plan, and plans lie where their first range does (see with_bytes).
    """
    known = dict(READERS) | (readers or {})
    each = F.struct("part", "location", "byte_offset", "byte_length", manifest.scheme(F.col("location")).alias("scheme"))
    whole = plans.groupBy(F.col("plan_id").cast("long").alias("plan_id")).agg(F.sort_array(F.collect_list(each)).alias("ranges"))
    at = whole.select("plan_id", "ranges", F.expr("ranges[0].location").alias("location"), F.expr("coalesce(ranges[0].byte_offset, 0)").alias("byte_offset"))
    spread = at.repartition(F.xxhash64("location", F.expr(f"byte_offset div {SPAN}"))).sortWithinPartitions("location", "byte_offset", "plan_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda ids, data: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["plan_id", "payload"])
        for b in batches:
            ids, data, held = [], [], 0
            for i, ranges in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                data.append(b"".join(one_read(known, attempts, i, r["scheme"], r["location"], r["byte_offset"], r["byte_length"]) for r in ranges))
                held += len(data[-1])
                if held >= OUT:
                    yield out(ids, data)
                    ids, data, held = [], [], 0
            if ids:
                yield out(ids, data)

    return spread.select("plan_id", "ranges").mapInArrow(read, "plan_id long, payload binary")


def clip_bytes(plans: DataFrame, whole: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """(plan_id, payload, ranged): by its ranges where a clip has a plan, else all of its object. whole: (plan_id, location) of every clip."""
    ranged = with_ranges(plans, readers).withColumn("ranged", F.lit(True))
    rest = whole.join(plans.select("plan_id").distinct(), "plan_id", "left_anti").select(F.col("plan_id").alias("sample_id"), "location", F.lit(None).cast("long").alias("byte_offset"), F.lit(None).cast("long").alias("byte_length"))
    return ranged.unionByName(with_bytes(rest, readers).select(F.col("sample_id").alias("plan_id"), "payload", F.lit(False).alias("ranged")))


def default_headers(bearer: str | None = None, lines: str | None = None) -> dict[str, str]:
    """Request headers from settings: a bearer token, and lines `Name: value` (also parted by a written \\n), of which an Authorization wins. Errors never show a value that is secret."""
    out: dict[str, tuple[str, str]] = {}
    if bearer and bearer.strip():
        out["authorization"] = ("Authorization", f"Bearer {bearer.strip()}")
    for line in (lines or "").replace("\\n", "\n").splitlines():
        if not line.strip():
            continue
        name, colon, value = (x.strip() for x in line.partition(":"))
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name) or not value:
            raise ValueError(f"a header is `Name: value`, which this isn't: {name if colon else '(no colon)'}")
        if re.search(r"[\x00-\x08\x0a-\x1f\x7f]", value):
            raise ValueError(f"not a value for {name}: {'(hidden)' if secret_header(name) else repr(value)}")
        out[name.lower()] = (name, value)
    return dict(out.values())


def secret_header(name: str) -> bool:
    return re.fullmatch(r"(?i)(proxy-)?authorization|(set-)?cookie|(x-)?api-key|x-(auth|access)-token", name) is not None


def shuffled_scan(n: int, seed: int, cap: int) -> Iterator[int]:
    """The order in which a reservoir of `cap` gives n things back: over its size a random one leaves for each that comes, in the end the rest in random order."""
    state = seed or 0x9E3779B97F4A7C15
    held: list[int] = []

    def pick() -> int:
        nonlocal state
        at = 0
        if len(held) > 1:
            for turn in (7, -9, 8):
                state ^= (state << turn if turn > 0 else state >> -turn) % (1 << 64)
            at = state % len(held)
        held[at], held[-1] = held[-1], held[at]
        return held.pop()

    for k in range(n):
        held.append(k)
        if len(held) > max(1, cap):
            yield pick()
    while held:
        yield pick()


def reservoir(rows: DataFrame, *order: str, seed: int, cap: int = 100_000, start: int = 0, end: int | None = None) -> DataFrame:
    """rows with sample_id, their place as a reservoir of `cap` gives them back; only places start .. end - 1.

    The order depends on all that came before, so one task goes through the rows' numbers, which stream by; the rows themselves stay where
    they are and meet their places in a join. Where any seeded order will do, `seeded` has no such task.
    """
    placed = manifest.with_dense_ids(rows, *order, name="_from")
    n = placed.count()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found: list[tuple[int, int]] = []
                for k, at in enumerate(shuffled_scan(n, seed, cap)):
                    if k >= start and (end is None or k < end):
                        found.append((at, k))
                    if len(found) == 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in range(2)], names=["_from", "sample_id"])
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in range(2)], names=["_from", "sample_id"])

    numbers = rows.sparkSession.range(1).coalesce(1).mapInArrow(places, "_from long, sample_id long")
    return placed.join(numbers, "_from").drop("_from")


def seeded(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows with sample_id in an order that the seed and the key alone decide."""
    keyed = rows.withColumn("_turn", F.xxhash64(F.lit(seed), F.col(key)))
    return manifest.with_dense_ids(keyed, "_turn", key).drop("_turn")


def jittered(seed: int, n: int) -> list[float]:
    """Delays of n tries, for tests of what waits."""
    r = random.Random(seed)
    return [delay(k, r.randrange(1 << 20)) for k in range(n)]
