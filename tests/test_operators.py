"""Cases worked out by hand, and random cases against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import wrap64
from tidemill.operators import batching, manifest, media, mixing, ranges


def mix(x):
    z = (x + wrap64.GOLDEN) % 2**64
    z = (z ^ z >> 30) * wrap64.FIRST % 2**64
    z = (z ^ z >> 27) * wrap64.SECOND % 2**64
    return z ^ z >> 31


def test_splitmix_of_edge_values(spark):
    xs = [0, 1, 2**31, 2**32 - 1, 2**62 + 12345, 2**63 - 1, 2**63, 2**64 - 1]
    rows = spark.createDataFrame([(k, wrap64.signed(x)) for k, x in enumerate(xs)], "k int, x long").select("k", wrap64.splitmix(F.col("x"))).collect()
    assert [r[1] for r in sorted(rows)] == [wrap64.signed(mix(x)) for x in xs]


def test_batches_against_a_loop(spark):
    rng = random.Random(5)
    for _ in range(50):
        lengths = np.array([rng.randint(0, 60) for _ in range(rng.randint(0, 40))], np.int64)
        rows, target, most = rng.randint(1, 8), rng.randint(20, 100), rng.randint(60, 120)
        low, high = batching.band(target, most)
        out, n, size, b = [], 0, 0, 0
        for x in lengths.tolist():
            if n >= rows or (n and size >= target) or (n and size + x > most) or (n and size >= low and size + x > high):
                b, n, size = b + 1, 0, 0
            out.append(b)
            n, size = n + 1, size + x
        assert batching.cutter(rows, target, most)(lengths).tolist() == out
    with pytest.raises(ValueError):
        batching.cutter(4, 10, 10)(np.array([11]))


def test_caps_and_band():
    assert batching.default_caps(128 << 20) == (32 << 20, -(-(32 << 20) * 9 // 10))
    assert batching.band(100, 1000) == (85, 115) and batching.band(1, 1) == (1, 1)


def test_mix_schedule():
    weights = mixing.whole_weights([0.7, 0.3])
    assert weights == [7, 3] and mixing.period(weights) == [0, 1, 0, 0, 0, 1, 0, 0, 1, 0]
    picks = mixing.period([5, 1, 1])
    assert sorted(picks) == [0] * 5 + [1, 2]
    for bad in ([], [0.0], [float("nan")], [1e-9]):
        with pytest.raises(ValueError):
            mixing.whole_weights(bad)


def test_windows_and_clips(spark):
    def loop(n, width, stride):
        out, at = [0], 0
        while at + width < n and at + stride < n:
            at += stride
            out.append(at)
        return out

    cases = [(n, w, s) for n in (0, 1, 7, 8, 9, 16, 30) for w in (1, 4, 8) for s in (1, 3, 8, 11)]
    for w, s in {(w, s) for _, w, s in cases}:
        got = spark.createDataFrame([(n,) for n, a, b in cases if (a, b) == (w, s)], "n long").select("n", media.window_starts(F.col("n"), w, s)).collect()
        assert all(r[1] == loop(r[0], w, s) for r in got)
    assert media.clips(spark.createDataFrame([(1, 11), (2, 3), (3, 17)], "media_id long, frames long"), 4, 2).groupBy("media_id").count().orderBy("media_id").collect() == [(1, 4), (3, 7)]


def test_plan_against_the_greedy_loop(spark):
    rng, chunks, want = random.Random(3), [], {}
    for m in range(60):
        at, rows = 0, []
        for k in range(rng.randint(1, 9)):
            at += rng.choice([0, 0, 50, 150, 151, 300])
            rows.append((m, k, k * 1000, k * 1000 + 1000, at, at + 500, int(k == 0 or rng.random() < 0.4)))
            at += 500
        chunks += rows
        anchor = max((r[2] for r in rows if r[6] and r[2] <= 2500), default=min(r[2] for r in rows if r[6]))
        parts = []
        for r in rows:
            if anchor <= r[2] < 6500:
                if parts and r[4] <= parts[-1][1] + 100:
                    parts[-1][1] = r[5]
                else:
                    parts.append([r[4], r[5]])
        while len(parts) > 2:
            k = min(range(len(parts) - 1), key=lambda k: parts[k + 1][0] - parts[k][1])
            parts[k][1] = parts.pop(k + 1)[1]
        want[m] = (anchor, len(parts), parts[0][0], parts[-1][1], sum(b - a for a, b in parts))
    table = spark.createDataFrame(chunks, "media_id long, chunk_index long, start_ms long, end_ms long, start_byte long, end_byte long, keyframe int")
    clips = spark.createDataFrame([(m, 0, 2500, 6500) for m in range(60)], "media_id long, clip_id long, clip_start_ms long, clip_end_ms long")
    assert {r[0]: tuple(r)[2:] for r in media.range_plan(table, clips, 2, 100).collect()} == want


def test_dense_ids_and_slices(spark):
    rows = manifest.with_dense_ids(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")), "k").orderBy("k").collect()
    assert [r["sample_id"] for r in rows] == list(range(1000))
    assert manifest.with_dense_ids(spark.range(0), "id").count() == 0
    for bad in ((1, None), (5, 4), (0, 11)):
        with pytest.raises(ValueError):
            manifest.sliced(spark.range(10), *bad, 10)


def test_last_of_equal_keys_wins(spark):
    row = spark.createDataFrame([("v;a=1;b;a=2; c = x=y",)], "h string").select(manifest.hint_fields(F.col("h"))).first()[0]
    assert row == {"a": "2", "c": "x=y"}


def test_percent_encoding(spark):
    assert spark.createDataFrame([("a b~é%/+",)], "x string").select(manifest.percent_encoded(F.col("x"))).first()[0] == "a%20b~%C3%A9%25%2F%2B"


def test_log_replay_ignores_other_lines(spark):
    log = spark.createDataFrame([("H v1 abc",), ("C 0 10",), ("P 10 20 15",), ("P 10 20 12",), ("P 10 x 12",), ("C 5",), ("",)], "line string")
    assert sorted(map(tuple, ranges.replayed(log).collect())) == [(10, True, None), (20, False, 15)]
    left = ranges.recovered(spark.createDataFrame([(0, 10), (10, 20), (20, 30)], "start_id long, end_id long"), ranges.replayed(log))
    assert sorted(map(tuple, left.collect())) == [(15, 20), (20, 30)]


def test_overlap_is_seen(spark):
    assert ranges.overlaps(spark.createDataFrame([(0, 10), (9, 20)], "start_id long, end_id long")).count() == 1
