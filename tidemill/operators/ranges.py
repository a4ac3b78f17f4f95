"""Work ranges: blocks of ids, their shuffled order, ranks, leases and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.wrap64 import GOLDEN, splitmix, unsigned_order, word
from tidemill.operators.manifest import with_dense_ids


def blocks(ids: DataFrame, size: int) -> DataFrame:
    """(start_id, end_id): blocks of `size` over 0 .. N-1, with N the number of rows; only they are counted, nothing is sorted."""
    n = ids.agg(F.count("*").alias("n"))
    return n.filter("n > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long"))).alias("start_id"), "n").select("start_id", F.least(F.col("start_id") + size, F.col("n")).alias("end_id"))


def block_key(start: Column, seed: int, epoch: int) -> Column:
    return splitmix(word(seed ^ (epoch * GOLDEN) % (1 << 64)).bitwiseXOR(start))


def shuffled(ranges: DataFrame, seed: int, epoch: int) -> DataFrame:
    """ranges with shuffle_key and position, their place in the epoch's order: a range sort and an offset for each partition, no window over all of them."""
    keyed = ranges.withColumn("shuffle_key", block_key(F.col("start_id"), seed, epoch)).withColumn("_order", unsigned_order(F.col("shuffle_key")))
    return with_dense_ids(keyed, "_order", "start_id", name="position").drop("_order")


def ranked(ranges: DataFrame, seed: int, epoch: int, world: int) -> DataFrame:
    return shuffled(ranges, seed, epoch).withColumn("rank", F.pmod("position", F.lit(world)).cast("int"))


def remainders(leases: DataFrame, now: int) -> DataFrame:
    """(lease_id, start_id, end_id): what expired leases leave, from their cursor on."""
    cursor = F.least(F.greatest("cursor", "start_id"), "end_id")
    return leases.filter(F.col("expires_ms") <= now).select("lease_id", cursor.alias("start_id"), "end_id").filter("start_id < end_id")


def overlaps(ranges: DataFrame, *by: str) -> DataFrame:
    """Neighbouring ranges that share ids, with next_start; empty when all is well. Without `by` neighbours meet by their place in a range sort, not in one window over all."""
    if by:
        following = F.lead("start_id").over(Window.partitionBy(*by).orderBy("start_id", "end_id"))
        return ranges.withColumn("next_start", following).filter("end_id > next_start")
    placed = with_dense_ids(ranges, "start_id", "end_id", name="_place")
    following = placed.select((F.col("_place") - 1).alias("_place"), F.col("start_id").alias("next_start"))
    return placed.join(following, "_place").filter("end_id > next_start").drop("_place")


def pop_order(queue: DataFrame) -> DataFrame:
    """(rank, start_id, end_id, turn): requeued ranges come before all others, for whoever asks first (rank null); the others are their rank's own, in order of position."""
    of = F.when(F.col("requeued"), F.lit(None).cast("int")).otherwise(F.col("rank"))
    turn = F.row_number().over(Window.partitionBy("rank").orderBy("position", "start_id")) - 1
    return queue.withColumn("rank", of).select("rank", "start_id", "end_id", turn.cast("long").alias("turn"))


def dead_nodes(beats: DataFrame, now: int, ttl: int) -> DataFrame:
    """(node, last_ms) of nodes whose last heartbeat is older than a lease lives."""
    return beats.groupBy("node").agg(F.max("seen_ms").alias("last_ms")).filter(F.lit(now) - F.col("last_ms") > ttl)


def released(queue: DataFrame, dead: DataFrame) -> DataFrame:
    """The queue in which the ranges of dead nodes are anybody's: requeued, and of no rank. Doing it again changes nothing."""
    gone = dead.select(F.col("node").alias("_gone")).distinct()
    joined = queue.join(gone, F.col("node").eqNullSafe(F.col("_gone")), "left")
    off = F.col("_gone").isNotNull()
    return joined.withColumn("requeued", F.col("requeued") | off).withColumn("node", F.when(~off, F.col("node"))).drop("_gone")


def drained(leases: DataFrame, queue: DataFrame) -> bool:
    """Whether no lease and no range is left."""
    return leases.isEmpty() and queue.isEmpty()


def accepted(progress: DataFrame) -> DataFrame:
    """progress (lease_id, seq, node, owner, start_id, end_id, cursor) with verdict: a report counts if its node owns the lease, its cursor is in the range, and no accepted report was ahead of it."""
    good = (F.col("node") == F.col("owner")) & F.col("cursor").between(F.col("start_id"), F.col("end_id"))
    ahead = F.max(F.when(good, F.col("cursor"))).over(Window.partitionBy("lease_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    verdict = F.when(F.col("node") != F.col("owner"), "not_owner").when(~F.col("cursor").between(F.col("start_id"), F.col("end_id")), "out_of_range").when(F.col("cursor") < ahead, "backwards").when(F.col("cursor") >= F.col("end_id"), "completed")
    return progress.withColumn("verdict", F.coalesce(verdict, F.lit("accepted")))


def replayed(log: DataFrame, expected: str | None = None) -> DataFrame:
    """From lines `C start end` and `P start end cursor`: (end_id, completed, cursor); lines of another form are left out.

    expected: the manifest's hash, which the log is to say in its header `H v1 <hash>`; a log without one, or with another's, is an error.
    """
    parts = F.split(F.trim("line"), " +")
    if expected is not None:
        heads = {r[0] for r in log.filter(F.trim("line").startswith("H v1 ")).select(F.trim(F.substring(F.trim("line"), 6, 1 << 20))).distinct().limit(2).collect()}
        if heads != {expected}:
            raise ValueError(f"the log is of {' and '.join(sorted(heads)) or 'no manifest'}, not of {expected}")
    fields = log.select(parts.alias("p")).filter("(p[0] = 'C' and size(p) = 3) or (p[0] = 'P' and size(p) = 4)")
    typed = fields.select(F.col("p")[0].alias("kind"), F.expr("try_cast(p[1] as bigint)").alias("start_id"), F.expr("try_cast(p[2] as bigint)").alias("end_id"), F.expr("try_cast(get(p, 3) as bigint)").alias("cursor")).filter("start_id < end_id and (kind = 'C' or cursor is not null)")
    return typed.groupBy("end_id").agg(F.max(F.col("kind") == "C").alias("completed"), F.max("cursor").alias("cursor"))


def unissued(ranges: DataFrame, issued: DataFrame, seed: int, epoch: int, world: int) -> DataFrame:
    """The ranges that were not issued, dealt anew to `world` ranks."""
    return ranked(ranges.join(issued.select("start_id"), "start_id", "left_anti").select("start_id", "end_id"), seed, epoch, world)


def recovered(ranges: DataFrame, state: DataFrame) -> DataFrame:
    """What is left of ranges after a replayed log."""
    s = state.select(F.col("end_id").alias("e"), "completed", "cursor")
    joined = ranges.join(s, F.col("end_id") == F.col("e"), "left").filter("not coalesce(completed, false)")
    return joined.select(F.greatest("start_id", F.coalesce("cursor", "start_id")).alias("start_id"), "end_id").filter("start_id < end_id")
