"""Operator 10, SimHash near-dedup by the generalised pigeonhole principle.

A document's fingerprint is the 256-bit SimHash of its set of lower-case words. Two documents are near copies when the first 64 bits
differ in at most `radius` places and all 256 in at most `radius_all`. The 64 bits are searched exactly: correlated bits are grouped
into `parts` partitions, and thresholds t_i >= -1 whose sum is radius - parts + 1 are shared out among them by dynamic programming on
candidate counts (from the histogram of each partition's values over the whole corpus). If two fingerprints differ in no more than
radius bits, some partition differs in no more than its t_i, so a probe with all values within t_i finds the pair; the enumeration is
split between the probing and the probed side. Every hit is verified. Groups are the connected components of the verified pairs.

Defined results: null texts count as empty; a text without any word, or a null doc_id, is nobody's copy; rows of one doc_id are one
document; identical fingerprints are one node, so a hot passage copied a million times costs one probe; an empty table gives an empty
result; very long texts count with all their words; extra columns are ignored, also those whose names differ from a needed one's in case alone. Ties of a bit's votes count as 0. The least doc_id of a group is the one to keep.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut_lineage, keyed_texts, mixed64, pieces
from .graph import components

WORDS, WIDTH = 4, 256
RADIUS, RADIUS_ALL, PARTS = 11, 44, 4
PRINTS = pa.schema([("doc_id", pa.int64()), *((f"f{k}", pa.int64()) for k in range(WORDS))])
SALTS = mixed64(np.arange(1, WORDS + 1, dtype=np.uint64))
word_pattern = re.compile(r"\w+")
#: By threshold: flips of the probing and of the probed side, and how often the two sides meet at distance 0, 1, ...
SIDES = {-1: (-1, -1, []), 0: (0, 0, [1]), 1: (1, 0, [1, 1]), 2: (1, 1, [None, 2, 2]), 3: (2, 1, [None, None, 3, 3])}
#: What a shuffled row costs, in verified candidates.
ROW_COST = 40


def fingerprint(words: set[str]) -> np.ndarray:
    """WORDS uint64 for a set of words."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    votes = np.zeros(WIDTH, dtype=np.int64)
    for at in range(0, len(h), 4096):
        bits = np.unpackbits(mixed64(h[at : at + 4096, None] ^ SALTS).view(np.uint8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)


def print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole):
            ids, prints = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words := set(word_pattern.findall(text.lower())):
                    ids.append(i)
                    prints.append(fingerprint(words))
            if ids:
                f = np.array(prints).view(np.int64)
                yield batch_of(PRINTS, ids, *(np.ascontiguousarray(f[:, k]) for k in range(WORDS)))


def fingerprints(docs: DataFrame) -> DataFrame:
    return keyed_texts(docs).filter("doc_id is not null and text <> ''").mapInArrow(print_batches, ", ".join(f"{f.name} long" for f in PRINTS))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((65, 65))
    for b in batches:
        bits = np.unpackbits(np.ascontiguousarray(b.column(0).to_numpy()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        v = np.hstack([bits.astype(np.float32) * 2 - 1, np.ones((len(bits), 1), np.float32)])
        total += v.T @ v
    i, j = np.divmod(np.arange(65 * 65), 65)
    yield pa.RecordBatch.from_arrays([pa.array(i * 65 + j), pa.array(total.ravel())], names=["cell", "total"])


def correlated_groups(total: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` groups, each grown from the most correlated free pair by the bit that is most correlated with it."""
    n = max(total[64, 64], 1.0)
    mean = total[64, :64] / n
    cov = total[:64, :64] / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(std, std))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(64)), []
    for left in range(parts, 0, -1):
        size, pool = len(free) // left, sorted(free)
        sub = corr[np.ix_(pool, pool)]
        group = [pool[k] for k in np.unravel_index(int(sub.argmax()), sub.shape)] if sub.max() > 0 else pool[:2]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(rest[int(corr[np.ix_(rest, group)].sum(1).argmax())])
        groups.append(sorted(group[:size]))
        free -= set(groups[-1])
    return groups


def candidate_counts(hist: np.ndarray, bits: int) -> list[float]:
    """Pairs of rows whose values in a partition are at distance 0, 1, 2 and 3, estimated from its histogram."""
    spectrum, width = hist.astype(np.float64), 1
    while width < len(hist):  # Walsh-Hadamard; pairs at distance d have a Krawtchouk weight by the popcount
        s = spectrum.reshape(-1, 2, width)
        spectrum = np.stack([s[:, 0] + s[:, 1], s[:, 0] - s[:, 1]], axis=1).ravel()
        width *= 2
    power = np.bincount(np.bitwise_count(np.arange(len(hist), dtype=np.uint32)), weights=spectrum**2, minlength=bits + 1) / len(hist)
    krawtchouk = lambda d, w: sum((-1) ** j * comb(w, j) * comb(bits - w, d - j) for j in range(d + 1))
    return [max(0.0, float(sum(krawtchouk(d, w) * power[w] for w in range(bits + 1)))) for d in range(4)]


def enumerated(bits: int, flips: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(bits), k)]


def shared_out(costs: list[dict[int, float]], total: int) -> list[int]:
    """One threshold for each partition, of the given sum, with the least summed cost: dynamic programming over the partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in cost.items():
                if s + t not in new or c + x < new[s + t][0]:
                    new[s + t] = (c + x, [*ts, t])
        best = new
    if total not in best:
        raise ValueError("no thresholds of this sum: use more partitions")
    return best[total][1]


def _costs(hist: np.ndarray, bits: int, rows: float) -> dict[int, float]:
    pairs = candidate_counts(hist, bits)
    out = {}
    for t, (probe, probed, times) in SIDES.items():
        meet = list(times)
        if t == 2:
            meet[0] = bits + 1
        if t == 3:
            meet[0], meet[1] = bits + 1, bits + 1
        out[t] = sum(p * m for p, m in zip(pairs, meet, strict=False)) + ROW_COST * rows * ((len(enumerated(bits, probe)) + len(enumerated(bits, probed))) if t >= 0 else 0)
    return out


def near_pairs(nodes: DataFrame, radius: int = RADIUS, radius_all: int = RADIUS_ALL, parts: int = PARTS) -> DataFrame:
    """(a, b) with a < b: all pairs of `nodes` (node, f0 .. f3; distinct, stored) within both radii."""
    total = np.zeros((65, 65))
    for r in nodes.select("f0").mapInArrow(_products, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect():
        total[divmod(r["cell"], 65)] = r["total"]
    groups = correlated_groups(total, parts)
    value = [reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.shiftrightunsigned("f0", b).bitwiseAND(F.lit(1)), k) for k, b in enumerate(g)]) for g in groups]
    hists = [np.zeros(1 << len(g)) for g in groups]
    for r in nodes.select(F.explode(F.array(*(F.struct(F.lit(i).alias("part"), v.alias("value")) for i, v in enumerate(value)))).alias("x")).groupBy("x.part", "x.value").count().toLocalIterator():
        hists[r[0]][r[1]] = r[2]
    limits = shared_out([_costs(h, len(g), max(total[64, 64], 1)) for h, g in zip(hists, groups, strict=True)], radius - parts + 1)

    def values_near(part: int, flips: int):
        at, v = F.lit(part << 32), value[part]
        masks = F.array(*(F.lit(m).cast("long") for m in enumerated(len(groups[part]), flips)))
        return F.transform(masks, lambda m: m.bitwiseXOR(v).bitwiseOR(at))

    def side(which: int, name: str) -> DataFrame:
        keys = [values_near(part, SIDES[t][which]) for part, t in enumerate(limits) if t >= 0]
        return nodes.select(F.col("node").alias(name), F.col("f0").alias(f"f{name}"), F.explode(F.concat(*keys)).alias("key"))

    probing, probed = side(0, "a"), side(1, "b")
    close = probing.join(probed, (probing["key"] == probed["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= radius))
    found = close.select("a", "b").distinct()
    more = lambda name: nodes.select(F.col("node").alias(name), *(F.col(f"f{k}").alias(f"{name}{k}") for k in range(WORDS)))
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(WORDS)])
    return found.join(more("a"), "a").join(more("b"), "b").filter(apart <= radius_all).select("a", "b")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, radius_all: int = RADIUS_ALL, parts: int = PARTS) -> DataFrame:
    """(doc_id, group_id, group_size, keep) for the documents that have a near copy; group_id is the group's least doc_id, which is kept."""
    prints = cut_lineage(fingerprints(docs).distinct())
    same = [f"f{k}" for k in range(WORDS)]
    nodes = cut_lineage(prints.groupBy(*same).agg(F.min("doc_id").alias("node")))
    roots = components(near_pairs(nodes, radius, radius_all, parts))
    grouped = prints.join(nodes, same).join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("group_id"))
    lowest = grouped.groupBy("doc_id").agg(F.min("group_id").alias("group_id"))
    sizes = lowest.groupBy("group_id").agg(F.count("*").alias("group_size")).filter("group_size > 1")
    return lowest.join(sizes, "group_id").select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("keep"))
