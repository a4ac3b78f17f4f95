"""Weighted interleaving of sources by a smooth round robin, whose schedule is periodic."""

from __future__ import annotations

from functools import reduce
from math import floor, gcd, isfinite

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1_000_000
BROADCAST_PICKS = 100_000  # a period is broadcast up to so many picks


def whole_weights(weights: list[float]) -> list[int]:
    if not weights or any(not isfinite(w) or w <= 0 for w in weights):
        raise ValueError("weights are finite and positive")
    scaled = [floor(w * SCALE + 0.5) for w in weights]
    if min(scaled) < 1:
        raise ValueError("a weight is too small")
    by = reduce(gcd, scaled)
    return [s // by for s in scaled]


def period(weights: list[int], offset: int = 0) -> list[int]:
    """One period of picks; its length is the sum of the weights."""
    n, total, state, out = len(weights), sum(weights), [0] * len(weights), []
    for _ in range(total):
        state = [s + w for s, w in zip(state, weights, strict=True)]
        pick = min((k for k in range(n) if state[k] == max(state)), key=lambda k: (k - offset) % n)
        state[pick] -= total
        out.append(pick)
    return out


def tie_offset(seed: int, epoch: int, n: int) -> int:
    return (seed % n + epoch % n) % n


def schedule(spark, picks: list[int], ticks: int) -> DataFrame:
    """(tick, source_no, pick_no): pick_no counts a source's own picks. No sort: each pick's number follows from its place in the period."""
    counts, rows = [0] * (max(picks) + 1), []
    for at, s in enumerate(picks):
        rows.append((at, s, counts[s]))
        counts[s] += 1
    table = spark.createDataFrame(pd.DataFrame([(*r, counts[r[1]]) for r in rows], columns=["at", "source_no", "before", "per"]), "at long, source_no int, before long, per long")
    turns = spark.range(ticks).select(F.col("id").alias("tick"), F.pmod("id", F.lit(len(picks))).alias("at"), F.expr(f"id div {len(picks)}").alias("turn"))
    return turns.join(F.broadcast(table) if len(picks) <= BROADCAST_PICKS else table, "at").select("tick", "source_no", (F.col("turn") * F.col("per") + F.col("before")).alias("pick_no"))


def drained(spark, weights: list[int], counts: list[int], offset: int = 0) -> DataFrame:
    """(tick, source_no, pick_no) until all sources have run out: one that is picked with nothing left leaves, and the pick is made anew.

    The round robin's state goes on over that, as in the reference, so each set of sources has a few picks of its own before its
    period; periods are counted, not walked through.
    """
    n, state, left, active, parts, tick = len(weights), [0] * len(weights), list(counts), [True] * len(weights), [], 0
    done = [0] * n
    while any(active):
        before, taken, block = list(state), [0] * n, []
        total = sum(w for w, a in zip(weights, active, strict=True) if a)
        while len(block) < total:
            state = [s + w if a else s for s, w, a in zip(state, weights, active, strict=True)]
            pick = max((k for k in range(n) if active[k]), key=lambda k: (state[k], -((k - offset) % n)))
            state[pick] -= total
            if taken[pick] == left[pick]:
                active[pick] = False
                break
            taken[pick] += 1
            block.append(pick)
        again = len(block) == total and state == before
        turns = min(have // took for have, took in zip(left, taken, strict=True) if took) if again else 1
        if block:
            parts.append((tick, block, turns, list(done)))
            tick += turns * len(block)
        done, left = [d + turns * t for d, t in zip(done, taken, strict=True)], [x - turns * t for x, t in zip(left, taken, strict=True)]
    if not parts:
        return spark.range(0).select(F.col("id").alias("tick"), F.lit(0).alias("source_no"), F.col("id").alias("pick_no"))
    starts = spark.createDataFrame([(k, bases) for k, (*_, bases) in enumerate(parts)], "part int, bases array<long>")
    plans = [schedule(spark, block, turns * len(block)).select((F.col("tick") + start).alias("tick"), "source_no", "pick_no", F.lit(k).alias("part")) for k, (start, block, turns, _) in enumerate(parts)]
    return reduce(DataFrame.unionByName, plans).join(F.broadcast(starts), "part").select("tick", "source_no", (F.col("pick_no") + F.element_at("bases", F.col("source_no") + 1)).alias("pick_no"))


def first_exhausted(weights: list[int], counts: list[int], offset: int = 0) -> tuple[int, int]:
    """(tick, source) of the first pick that finds nothing left: where a mix that doesn't allow exhaustion ends with an error."""
    picks = period(weights, offset)
    per = [picks.count(k) for k in range(len(weights))]
    best = None
    for k, have in enumerate(counts):
        turns, rest = divmod(have, per[k])
        at = [t for t, s in enumerate(picks) if s == k][rest]
        if best is None or turns * len(picks) + at < best[0]:
            best = (turns * len(picks) + at, k)
    return best


def mixed(spark, weights: list[float], counts: list[int], seed: int, epoch: int, exhausted: str = "allow", ticks: int | None = None) -> DataFrame:
    """(tick, source_no, pick_no): the whole mix. exhausted: `allow` goes on among the others, `error` fails if `ticks` (all, if not given) reach past a source's end."""
    whole, offset = whole_weights(weights), tie_offset(seed, epoch, len(weights))
    if len(counts) != len(weights):
        raise ValueError("there are as many counts as weights")
    if exhausted not in ("allow", "error"):
        raise ValueError(f"exhausted is allow or error, not {exhausted!r}")
    plan = drained(spark, whole, counts, offset)
    if exhausted == "error":
        tick, source = first_exhausted(whole, counts, offset)
        if tick < (sum(counts) if ticks is None else ticks):
            raise ValueError(f"source {source} has run out at tick {tick}")
    return plan if ticks is None else plan.filter(F.col("tick") < ticks)


def shared_cap(caps: list[int], override: int | None = None, rss_cap: int | None = None) -> int:
    """What all sources together may have in flight: the least of their caps, of the override and of the memory limit."""
    if not caps or min(caps) <= 0:
        raise ValueError("every source has a cap over 0")
    return min(x for x in (*caps, override, rss_cap) if x is not None)


def within_cap(batches: DataFrame, cap: int) -> DataFrame:
    """batches (.., bytes), with an error for one beyond the shared cap."""
    return batches.withColumn("bytes", F.when(F.col("bytes") > cap, F.raise_error(F.concat(F.lit("a batch is over the shared cap: "), F.col("bytes").cast("string"))).cast("long")).otherwise(F.col("bytes")))


def checked_sources(batch_sizes: list[int], weights: list[float], wanted: int | None = None) -> None:
    """An error unless there is a source, each has a weight and the same batch size, and no number of leases is asked for."""
    if not batch_sizes or len(batch_sizes) != len(weights):
        raise ValueError("a mix has one source or more, and a weight for each")
    if len(set(batch_sizes)) > 1:
        raise ValueError(f"sources have the same batch size, not {sorted(set(batch_sizes))}")
    if wanted is not None:
        raise ValueError("a mix doesn't take leases of its own")


def snapshots(plan: DataFrame, every: int = 64) -> DataFrame:
    """The ticks at which a snapshot is due: each `every`-th but the first."""
    return plan.filter((F.col("tick") > 0) & (F.pmod("tick", F.lit(every)) == 0)).select("tick")


def realised(delivered: DataFrame, sources: int) -> DataFrame:
    """(source_no, n, ratio) for every source: its share of the delivered samples, 0.0 where nothing was delivered."""
    counted = delivered.groupBy("source_no").agg(F.count("*").alias("n"))
    every = delivered.sparkSession.range(sources).select(F.col("id").cast("int").alias("source_no"))
    whole = every.join(counted, "source_no", "left").fillna({"n": 0})
    total = whole.agg(F.sum("n").alias("all"))
    return whole.crossJoin(F.broadcast(total)).select("source_no", "n", F.when(F.col("all") > 0, F.col("n").cast("double") / F.col("all").cast("double")).otherwise(0.0).alias("ratio"))  # of one row


def interleaved(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (source_no, pick_no, ..) at the ticks of their picks; a source that has run out leaves its ticks empty."""
    return plan.join(rows, ["source_no", "pick_no"])


def starvation(plan: DataFrame, width: int) -> DataFrame:
    """(source_no, starved): how often more than `width` ticks lay between a source's picks."""
    before = F.lag("tick").over(Window.partitionBy("source_no").orderBy("tick"))
    return plan.withColumn("gap", F.col("tick") - before).groupBy("source_no").agg(F.sum(F.coalesce((F.col("gap") > width).cast("long"), F.lit(0).cast("long"))).alias("starved"))
