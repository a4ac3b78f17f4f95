"""Delivery progress as a stream: the cursor of each lease, and nodes whose heartbeats stopped."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def cursors(reports: DataFrame) -> DataFrame:
    """(lease_id, cursor, reports) of a stream (lease_id, node, owner, start_id, end_id, cursor); run in update or complete mode.

    A cursor is the greatest that its owner reported in range, so reports that come late or twice change nothing.
    """
    good = reports.filter((F.col("node") == F.col("owner")) & F.col("cursor").between(F.col("start_id"), F.col("end_id")))
    return good.groupBy("lease_id").agg(F.max("cursor").alias("cursor"), F.count("*").alias("reports"))


REPORT = "lease_id long, seq long, node long, owner long, start_id long, end_id long, cursor long"
VERDICT = "lease_id long, seq long, cursor long, verdict string"


def accepted(reports: DataFrame, ttl_ms: int = 30_000) -> DataFrame:
    """VERDICT for each of a stream of REPORT, append mode: the state of a lease is its cursor.

    A report counts if its node owns the lease, its cursor is in the range and not behind the last that counted; it gives the lease ttl_ms
    more. A lease that hears nothing for so long expires: its last row has the cursor from which on it is to be given out again, and its state goes.
    """

    def judged(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (at,) = state.get
            state.remove()
            yield pd.DataFrame({"lease_id": [key[0]], "seq": [-1], "cursor": [at], "verdict": ["expired"]})
            return
        at, out = (state.get[0] if state.exists else -1), []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            verdict = "not_owner" if r.node != r.owner else "out_of_range" if not r.start_id <= r.cursor <= r.end_id else "backwards" if r.cursor < at else "completed" if r.cursor >= r.end_id else "accepted"
            if verdict in ("accepted", "completed"):
                at = int(r.cursor)
            out.append((key[0], r.seq, r.cursor, verdict))
        if at >= 0:
            state.update((at,))
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["lease_id", "seq", "cursor", "verdict"])

    return reports.groupBy("lease_id").applyInPandasWithState(judged, VERDICT, "at long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def beats(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, node, beats) of a stream (ts, node), for closed windows once the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "node").agg(F.count("*").alias("beats"))


def deliver(batches: DataFrame, sink, checkpoint: str):
    """A running query that hands each micro-batch to sink(df, epoch); the checkpoint folder is what a restart resumes from."""
    return batches.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(state: dict, path: str) -> None:
    """A small state as JSON, written beside its place and renamed: a reader sees the old one or the new one."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(part := f"{path}.{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
        json.dump({"version": 1, "state": state}, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def found(path: str) -> dict | None:
    """The state that was kept; None where there is none, an error where it is of another version or no JSON."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    if said.get("version") != 1:
        raise ValueError(f"{path} is of version {said.get('version')}")
    return said["state"]
