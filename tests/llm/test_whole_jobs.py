"""Each query does the whole of its job: cases that a shorter way leaves out."""

from collections import defaultdict
from functools import lru_cache
from itertools import product
from math import lgamma, log
from pathlib import Path

import numpy as np
import pytest

from tidemill.llm import op1_chunks, op3_ctw, op6_tiles, op9_surrogates, queries


def stored(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_scores_mix_all_depths(spark, tmp_path):
    """Costs are ratios of weighted block probabilities of a tree of six bytes, with the byte and without it."""
    depth, rows = 6, [(1, "abracadabra abracadabra"), (2, "abba"), (3, "banana bandana banana bandana"), (4, "na\u00efve abracadabra"), (5, None), (6, "")]
    places = [(x, tuple(t[i - d] if i >= d else 0 for d in range(1, depth + 1)), doc) for doc, s in rows for t in [(s or "").encode()] for i, x in enumerate(t)]

    def weighted(extra=None):
        by = defaultdict(lambda: [0, 0])
        for x, ctx, _ in [*places, *([extra] if extra else [])]:
            for k in range(8):
                for d in range(depth + 1):
                    by[(256 | x) >> (8 - k), ctx[:d]][(x >> (7 - k)) & 1] += 1
        below = defaultdict(list)
        for node, ctx in by:
            if ctx:
                below[node, ctx[:-1]].append(ctx)
        kt = lambda z, o: lgamma(z + 0.5) + lgamma(o + 0.5) - lgamma(z + o + 1) - 2 * lgamma(0.5)

        @lru_cache(None)
        def p(node, ctx):
            own = kt(*by[node, ctx])
            return own if len(ctx) == depth else np.logaddexp(own, sum(p(node, c) for c in below[node, ctx])) - log(2)

        return p

    before, want = weighted(), defaultdict(float)
    cost = {}
    for x, ctx, doc in places:
        if (x, ctx) not in cost:
            after = weighted((x, ctx, 0))
            cost[x, ctx] = sum(before(n, ()) - after(n, ()) for n in [(256 | x) >> (8 - k) for k in range(8)]) / log(2)
        want[doc] += cost[x, ctx]
    path = stored(spark, tmp_path, rows)
    for scores in (queries.queries()["op3_lm_scoring"](spark, path), *(op3_ctw.tree_scores(spark.read.parquet(f"{path}/documents.parquet"), share) for share in (1, 9, 25))):  # whatever is taken to be frequent
        found = {r["doc_id"]: r for r in scores.collect()}
        assert set(found) == {d for d, _ in rows} and op3_ctw.DEEP == depth
        for d, s in rows:
            assert found[d]["n_bytes"] == len((s or "").encode()) and found[d]["code_bits"] == pytest.approx(want[d], rel=1e-4)
            assert (found[d]["bits_per_byte"] is None) == (not s)


def test_each_repeated_chunk_is_kept_once(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    where, mine = defaultdict(list), {}
    for d, t in sorted(rows):
        data = t.encode()
        ends = next((e for _, e in op1_chunks.cuts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))), [])
        mine[d] = list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []
        for a, b in mine[d]:
            where[data[a:b]].append((d, a, b))
    gone, told = defaultdict(set), defaultdict(set)
    for r in queries.queries()["op1_substring_dedup"](spark, small).collect():
        span = range(r["start_byte"], r["end_byte"])
        assert not told[r["doc_id"]].intersection(span)
        told[r["doc_id"]].update(span)
        if not r["keep"]:
            gone[r["doc_id"]].update(span)
    repeated = {c: at for c, at in where.items() if len(at) > 1}
    mixed = 0
    for at in repeated.values():
        left = [(d, a) for d, a, b in at if a not in gone[d]]
        assert all((a in gone[d]) == (b - 1 in gone[d]) for d, a, b in at)
        assert at[0][:2] in left and all(a not in told[d] for d, a in left[1:])  # what no span reports is no passage
        mixed += len(at) > len(left)
    assert mixed
    runs = set()  # spans are as long as they were
    for r in op1_chunks.substring_dedup(spark.read.parquet(f"{small}/documents.parquet")).collect():
        runs |= {(r["doc_id"], k) for k in range(r["start_byte"], r["end_byte"])}
    assert runs == {(d, k) for d, ks in told.items() for k in ks}


SIDE_BY_SIDE = [
    ("email", "jane.doe@example.com"), ("secret", "password=hunter2abc"), ("ip", "190.137.223.204"), ("iban", "DE89370400440532013000"), ("card", "4845168114407329"), ("card", "4111 1111 1111 1111"), ("card", "4111-1111-1111-1111"),
    ("national", "123-45-6789"), ("phone", "555-123-4567"), ("phone", "+1 (826) 555-4081"), ("phone", "(826) 555-4081"),
]


@pytest.mark.parametrize("between", [" ", ", ", "\n", " - "])
def test_entities_side_by_side(between):
    for a, b in product(SIDE_BY_SIDE, SIDE_BY_SIDE):
        text = a[1] + between + b[1]
        assert [(k, text[s:e]) for s, e, k in op9_surrogates.entities(text)] == [a, b], text


def test_cards_before_other_digits():
    found = lambda t: [(k, t[s:e]) for s, e, k in op9_surrogates.entities(t)]
    for rest in ("123", "12/27", "7", "1 2 3"):
        assert found(f"4111 1111 1111 1111 {rest}") == [("card", "4111 1111 1111 1111")]
    assert found("1 4111 1111 1111 1111") == [("card", "4111 1111 1111 1111")]
    assert found("555-123-4567 555-123-4568") == [("phone", "555-123-4567"), ("phone", "555-123-4568")]
    assert found("the numbers 4111 1111 1111 1112 and 12345678901234567890123") == []


def test_near_vectors_write_what_follows_the_input(spark):
    """Vectors without clusters may have links in most cells; what is shuffled and stored is still a few times the input."""
    n, dim, cells = 4000, 64, 40
    x = np.random.default_rng(3).normal(size=(n, dim)).astype(np.float32)
    x[1::50] = x[0::50] + np.float32(0.01)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").cache()
    assert table.count() == n
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        shuffled = sc.statusStore().executorSummary("driver").totalShuffleWrite()
        return shuffled + sum(p.stat().st_size for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("part-*"))

    before = written()
    found = {r["vec_id"]: (r["n_links"], r["group_id"]) for r in op6_tiles.near_vectors(table, cell_rows=n // cells, block_rows=n // cells).collect()}
    assert written() - before < 6 * n * dim * 4
    assert found == {k: (int(k % 50 < 2), k - (k % 50 == 1)) for k in range(n)}
