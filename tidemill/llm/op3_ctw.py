"""Operator 3, LM scoring by context-tree weighting (Willems, Shtarkov and Tjalkens, 1995), binary decomposition by Volf.

A byte is eight binary decisions; each of the 255 inner nodes of that binary tree has a context tree over the preceding bytes, down to
`DEEP` = 6 of them. Every tree node holds the Krichevsky-Trofimov estimate of its zeros and ones over the whole corpus, and the
weighted probability of a node is one half its own estimate plus one half the product of its 256 children's. The conditional
probability that this mixture gives to the next bit, after the corpus, is w * KT(node) + (1 - w) * P(child), with w the posterior
weight of the node; a document's code length is the sum over its bytes.

`tree_scores` is the operator. A gram is six bytes of context, the nearest first, and the byte after them: 56 bits, exact and not
hashed. The texts are stored in blobs, and each blob's distinct grams with their counts are shuffled by their nearest bytes, so
a bucket holds whole subtrees: from depth 3 on, and below a context that has 1 / SHARE of the corpus or more from a depth more on, until none has so
much or six bytes are reached. A first pass sums what the subtrees say to the nodes above (at most 2**24 counts and 2**24
weights of two bytes of context, and 255 of each of the SHARE contexts at most that are so frequent at each depth; their mixture is broadcast), a second sends each blob the costs of its grams, to be added up by document. What is gathered
grows with the distinct grams of the corpus, and what a bucket holds is bounded by the corpus over SHARE, whatever is frequent in it. `lm_scores` is the same with a tree of two bytes, whose costs by (two bytes of context,
byte) are one table.

Defined results: a document counts in the corpus that scores it; before a text's first byte stand as many zero bytes as the tree is deep; null and empty texts
have 0 bytes, 0 bits and null bits_per_byte; a null doc_id is kept; repeated rows count and are scored each time; an empty table gives
an empty result; extra columns are ignored, also those whose names differ from a needed one's in case alone. A text longer than a blob is a blob
of its own, which one task holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut_lineage, flat_bytes, keyed_texts, mixed64, pieces

DEPTH = 2
DEEP, TOP = 6, 2  # of tree_scores: the whole tree, and what of it is above the buckets
BLOB, SHARE = 8 << 20, 4096
BUCKETS = 4  # to a shuffle partition
BLOBS = pa.schema([("blob", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("packed", pa.binary())])
GRAMS = pa.schema([("bucket", pa.int32()), ("blob", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
TOPS = pa.schema([("level", pa.int32()), ("depth", pa.int32()), ("node", pa.int64()), ("value", pa.float64())])
COSTS = pa.schema([("bucket", pa.int32()), ("blob", pa.int64()), ("costs", pa.binary())])
SCORES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("code_bits", pa.float64())])


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, the two bytes before it in its text and itself, as a number of 24 bits."""
    b = data.astype(np.uint32)
    one, two = np.zeros_like(b), np.zeros_like(b)
    one[1:], two[2:] = b[:-1], b[:-2]
    starts = offsets[:-1][np.diff(offsets) > 0]
    one[starts] = two[starts] = 0
    later = starts + 1
    two[later[later < len(b)]] = 0
    return (two << np.uint32(16)) | (one << np.uint32(8)) | b


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for whole in batches:
        for batch in pieces(whole, 16 << 20):
            data, offsets = flat_bytes(batch.column(1))
            if len(data):
                total = np.zeros(1 << 24, np.int64) if total is None else total
                total += np.bincount(trigrams(data, offsets), minlength=1 << 24)
    if total is not None:
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(seen[at : at + (1 << 16)]), pa.array(total[seen[at : at + (1 << 16)]])], names=["gram", "n"])


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): how often each byte occurs after each two bytes, over all documents."""
    return keyed_texts(docs).filter("text <> ''").mapInArrow(count_batches, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the KT block probability of any sequence of so many zeros and ones."""
    lg = np.frompyfunc(lgamma, 1, 1)
    out = np.zeros(zeros.shape)
    some = (zeros + ones) > 0
    z, o = zeros[some], ones[some]
    if len(z):
        out[some] = lg(z + 0.5).astype(float) + lg(o + 0.5).astype(float) - lg(z + o + 1.0).astype(float) - 2 * lgamma(0.5)
    return out


def _node_counts(by_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts by byte (.., 256) to zeros and ones of the 255 binary nodes (.., 256; node 1 is the root, 2n and 2n+1 follow n)."""
    whole = np.zeros((*by_byte.shape[:-1], 512))
    whole[..., 256:] = by_byte
    for n in range(255, 0, -1):
        whole[..., n] = whole[..., 2 * n] + whole[..., 2 * n + 1]
    return whole[..., 0:512:2].copy(), whole[..., 1:512:2].copy()


PATH = np.array([[(256 | x) >> (8 - k) for k in range(8)] for x in range(256)])
BITS = np.array([[(x >> (7 - k)) & 1 for k in range(8)] for x in range(256)], dtype=bool)


def costs(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits for each of the 2**24 (context, byte) by the weighted mixture over depths 0, 1 and 2 after the counted corpus."""
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order].astype(float)
    two, one, last = grams >> 16, (grams >> 8) & 255, grams & 255
    first = np.zeros((256, 256))
    np.add.at(first, (one, last), counts)
    weight = lambda own, below: 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
    log_half = lambda own, below: np.logaddexp(own, below) - np.log(2)
    blocks = [np.flatnonzero(one == b) for b in range(256)]
    z1, o1 = _node_counts(first)
    own1, below1 = _log_kt(z1, o1), np.zeros((256, 256))
    for b in range(256):
        if len(at := blocks[b]):
            uniq, row = np.unique(two[at], return_inverse=True)
            cells = np.zeros((len(uniq), 256))
            np.add.at(cells, (row, last[at]), counts[at])
            below1[b] = _log_kt(*_node_counts(cells)).sum(0)
    z0, o0 = _node_counts(first.sum(0))
    own0, below0 = _log_kt(z0, o0), log_half(own1, below1).sum(0)
    w0, w1 = weight(own0, below0), weight(own1, below1)
    kt = lambda z, o: (o + 0.5) / (z + o + 1)
    p0 = kt(z0, o0)
    out = np.empty((256, 256, 256), np.float32)  # byte before last, last byte, next byte

    def bits(one_is: np.ndarray) -> np.ndarray:
        p = one_is[..., PATH]
        return -np.log2(np.where(BITS, p, 1 - p)).sum(-1)

    for b in range(256):
        unseen = w0 * p0 + (1 - w0) * (w1[b] * kt(z1[b], o1[b]) + (1 - w1[b]) * 0.5)
        out[:, b, :] = bits(unseen)
        if len(at := blocks[b]):
            uniq, row = np.unique(two[at], return_inverse=True)
            cells = np.zeros((len(uniq), 256))
            np.add.at(cells, (row, last[at]), counts[at])
            deep = kt(*_node_counts(cells))
            out[uniq, b, :] = bits(w0 * p0 + (1 - w0) * (w1[b] * kt(z1[b], o1[b]) + (1 - w1[b]) * deep))
    return out.reshape(-1)


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, code_bits, bits_per_byte) for every row."""
    grams, n = [], []
    for r in corpus_counts(docs).toLocalIterator():  # never over 2**24 rows
        grams.append(r[0])
        n.append(r[1])
    table = docs.sparkSession.sparkContext.broadcast(costs(np.array(grams, np.int64), np.array(n, np.int64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                data, offsets = flat_bytes(batch.column(1))
                sums = np.concatenate([[0.0], np.cumsum(table.value[trigrams(data, offsets)], dtype=np.float64)])
                length = np.diff(offsets)
                yield batch_of(SCORES, batch.column(0), length, np.where(length > 0, sums[offsets[1:]] - sums[offsets[:-1]], 0.0))

    return keyed_texts(docs).mapInArrow(score, "doc_id long, n_bytes long, code_bits double").withColumn("bits_per_byte", F.expr("code_bits / nullif(n_bytes, 0)"))


def deep_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, the DEEP bytes before it in its text, the nearest in the highest place, and itself."""
    grams = data.astype(np.int64)
    within = (np.arange(len(data), dtype=np.int32) - np.repeat(offsets[:-1].astype(np.int32), np.diff(offsets)))  # of a blob, which is under 2 GiB
    for d in range(1, DEEP + 1):
        before = np.where(within[d:] >= d, data[:-d], np.uint8(0)).astype(np.int64)
        before <<= 8 * (DEEP + 1 - d)
        grams[d:] |= before
    return grams


def blob_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to blobs of about BLOB bytes, numbered by task."""
    number, squeeze = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3).compress
    ids, sizes, parts, held = [], [], [], 0

    def blob() -> pa.RecordBatch:
        return batch_of(BLOBS, [number], [ids], [sizes], [squeeze(b"".join(parts))])

    for whole in batches:
        for batch in pieces(whole, BLOB // 4):
            data, offsets = flat_bytes(batch.column(1))
            if ids and held + len(data) > BLOB:
                yield blob()
                number, ids, sizes, parts, held = number + 1, [], [], [], 0
            ids, sizes, held = ids + batch.column(0).to_pylist(), sizes + np.diff(offsets).tolist(), held + len(data)
            parts.append(data.tobytes())
    if ids:
        yield blob()


def _blob_grams(sizes: list[int], packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.cumsum([0, *sizes])
    return deep_grams(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8), offsets), offsets


def contexts(grams: np.ndarray, depth: int) -> np.ndarray:
    return grams >> (8 * (DEEP + 1 - depth))


def frequent_batches(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """(depth, context, n): of each blob the contexts of more than TOP bytes, less than DEEP, that have 1 / share of it or more."""
    for batch in batches:
        for row in batch.select(["sizes", "packed"]).to_pylist():
            grams, _ = _blob_grams(row["sizes"], row["packed"])
            least = len(grams) / share
            for depth in range(TOP + 1, DEEP):
                found, n = np.unique(contexts(grams, depth).astype(np.uint32) if depth < 5 else contexts(grams, depth), return_counts=True)
                found, n = found[n >= least].astype(np.int64), n[n >= least]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), depth, np.int32)), pa.array(found), pa.array(n)], names=["depth", "context", "n"])
                if not len(found):
                    break
                here = contexts(grams, depth)
                grams = grams[found[np.minimum(np.searchsorted(found, here), len(found) - 1)] == here]


def fronts(grams: np.ndarray, hot: dict[int, np.ndarray]) -> np.ndarray:
    """The depth from which on each gram's subtree is in one bucket: the first that isn't frequent."""
    out = np.full(len(grams), TOP + 1)
    for depth in range(TOP + 1, DEEP):
        if len(found := hot.get(depth, ())):
            at = np.flatnonzero(out == depth)
            here = contexts(grams[at], depth)
            out[at[found[np.minimum(np.searchsorted(found, here), len(found) - 1)] == here]] = depth + 1
    return out


def _buckets(grams: np.ndarray, n: int, hot: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts sorted grams by bucket, and where in it each bucket ends; a bucket has whole subtrees."""
    front = fronts(grams, hot)
    bucket = (mixed64((grams >> (8 * (DEEP + 1 - front))) * 8 + front) % np.uint64(n)).astype(np.int32)
    return np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=n))


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _loose(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def gram_batches(batches: Iterator[pa.RecordBatch], n: int, hot: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.select(["blob", "sizes", "packed"]).to_pylist():
            grams, counts = np.unique(_blob_grams(row["sizes"], row["packed"])[0], return_counts=True)
            order, ends = _buckets(grams, n, hot)
            starts = np.concatenate([[0], ends[:-1]])
            some = np.flatnonzero(ends > starts)
            cells = [order[starts[k] : ends[k]] for k in some]
            if len(some):
                yield batch_of(GRAMS, some, [row["blob"]] * len(some), [_packed(np.diff(grams[c], prepend=0)) for c in cells], [_packed(counts[c]) for c in cells])


SMALL = np.array([lgamma(k / 2) if k else 0.0 for k in range(64)])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function at positive halves and wholes."""
    y = np.maximum(x, 16.0)
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(x < 32, SMALL[np.minimum(2 * x, 63).astype(np.int64)], series)


def _kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - 2 * lgamma(0.5)


class Level:
    """The trees of the binary nodes after k bits of the next byte, from the deepest context up to depth `top`.

    A node is numbered (context, nearest byte first, then the k bits); above a node are those with one byte of context less. p is the
    mixture's probability of a one at each deepest node, of the depths from `top` on.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, k: int, depth: int, top: int, below: tuple | None = None):
        node, bit = grams >> (8 - k), (grams >> (7 - k)) & 1
        first = np.flatnonzero(np.diff(node, prepend=-1))
        self.k, self.bit = k, bit.astype(bool)
        self.row = np.cumsum(np.diff(node, prepend=-1) != 0) - 1
        self.nodes = node[first]
        total, ones = np.add.reduceat(counts, first), np.add.reduceat(counts * bit, first)
        zeros = total - ones
        own = _kt_block(zeros, ones)
        self.keep, self.rest = (ones + 0.5) / (total + 1), np.zeros(len(first))  # p = keep + rest * the deeper p
        log_p = own
        if below is not None:  # weights of children that are elsewhere
            log_below = np.zeros(len(first))
            log_below[np.searchsorted(self.nodes, below[0])] = below[1]
            w = self._weight(own, log_below)
            self.keep, self.rest, log_p = self.keep * w, 1 - w, np.logaddexp(own, log_below) - np.log(2)
        at, nodes = np.arange(len(first)), self.nodes
        for _ in range(depth - top):
            nodes, up = np.unique(self.above(nodes), return_inverse=True)
            zeros, ones = np.bincount(up, zeros), np.bincount(up, ones)
            own, log_below = _kt_block(zeros, ones), np.bincount(up, log_p)
            w, at = self._weight(own, log_below), up[at]
            self.keep = (w * (ones + 0.5) / (zeros + ones + 1))[at] + (1 - w)[at] * self.keep
            self.rest = (1 - w)[at] * self.rest
            log_p = np.logaddexp(own, log_below) - np.log(2)
        self.at, self.top_nodes, self.log_p = at, nodes, log_p

    @staticmethod
    def _weight(own: np.ndarray, below: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))

    def above(self, nodes: np.ndarray) -> np.ndarray:
        return (nodes >> (self.k + 8) << self.k) | (nodes & ((1 << self.k) - 1))


def _merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of a bucket: each blob's grams, and the distinct grams of all with their counts."""
    each = [np.cumsum(_loose(g, np.int64)) for g in table["grams"].to_pylist()]
    grams, place = np.unique(np.concatenate(each), return_inverse=True)
    counts = np.bincount(place, np.concatenate([_loose(c, np.int64) for c in table["counts"].to_pylist()]))
    return each, grams, counts


def each_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The buckets of a partition that is sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        bucket = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and lo < hi and held[0].column(0)[0].as_py() != bucket[lo]:
                yield pa.Table.from_batches(held)
                held = []
            if lo < hi:
                held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def bucket_tops(table: pa.Table, hot: dict[int, np.ndarray]) -> pa.Table:
    """What a bucket says to the nodes above its subtrees: at level 8 the counts by (context, byte), at level k the log weights of what is below the nodes."""
    _, grams, counts = _merged(table)
    front, out = fronts(grams, hot), []
    for f in np.unique(front):
        g, c = grams[front == f], counts[front == f]
        node, up = np.unique((contexts(g, f - 1) << 8) | (g & 255), return_inverse=True)
        out.append((8, f - 1, node, np.bincount(up, c)))
        for k in range(8):
            level = Level(g, c, k, DEEP, f)
            node, up = np.unique(level.above(level.top_nodes), return_inverse=True)
            out.append((k, f - 1, node, np.bincount(up, level.log_p)))
    lengths = [len(n) for *_, n, _ in out]
    return pa.table([np.repeat([x[j] for x in out], lengths).astype(np.int32) for j in range(2)] + [np.concatenate([x[j] for x in out]) for j in (2, 3)], schema=TOPS)


def _summed(nodes: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    node, up = np.unique(np.concatenate(nodes), return_inverse=True)
    return node, np.bincount(up, np.concatenate(values), len(node))


def top_mixture(level: np.ndarray, depth: np.ndarray, node: np.ndarray, value: np.ndarray) -> list[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each k and depth: the nodes above the buckets, sorted, and what p of a bit is there, as keep + rest * the p from the next depth on."""
    part = {(k, d): (node[at], value[at]) for k in range(9) for d in range(DEEP) if len(at := np.flatnonzero((level == k) & (depth == d)))}
    nothing = (np.zeros(0, np.int64), np.zeros(0))
    counts = {}
    for d in range(DEEP - 1, -1, -1):
        shorter = lambda n: (n >> 16 << 8) | (n & 255)
        deeper, n = counts.get(d + 1, nothing)
        counts[d] = _summed([part.get((8, d), nothing)[0], shorter(deeper)], [part.get((8, d), nothing)[1], n])
    out = []
    for k in range(8):
        above = lambda n: (n >> (k + 8) << k) | (n & ((1 << k) - 1))  # noqa: B023, E731
        kept, children = {}, nothing
        for d in range(DEEP - 1, -1, -1):
            short, n = counts[d]
            nodes, up = np.unique(short >> (8 - k), return_inverse=True)
            total, ones = np.bincount(up, n, len(nodes)), np.bincount(up, n * ((short >> (7 - k)) & 1), len(nodes))
            own, log_below = _kt_block(total - ones, ones), np.zeros(len(nodes))
            for below, log_p in (part.get((k, d), nothing), (above(children[0]), children[1])):
                np.add.at(log_below, np.searchsorted(nodes, below), log_p)
            kept[d] = (nodes, Level._weight(own, log_below), (ones + 0.5) / (total + 1))
            children = (nodes, np.logaddexp(own, log_below) - np.log(2))
        found, keep, rest = {}, np.zeros(1), np.ones(1)
        for d in range(DEEP):
            nodes, w, p = kept[d]
            at = np.searchsorted(kept[d - 1][0], above(nodes)) if d else np.zeros(len(nodes), int)
            keep, rest = keep[at] + rest[at] * w * p, rest[at] * (1 - w)
            found[d] = (nodes, keep, rest)
        out.append(found)
    return out


def gram_costs(grams: np.ndarray, counts: np.ndarray, top: list, hot: dict[int, np.ndarray]) -> np.ndarray:
    """Bits of each of a bucket's grams by the whole mixture."""
    front, bits = fronts(grams, hot), np.zeros(len(grams))
    for f in np.unique(front):
        here = np.flatnonzero(front == f)
        for k in range(8):
            x = Level(grams[here], counts[here], k, DEEP, f)
            nodes, keep, rest = top[k][f - 1]
            at = np.searchsorted(nodes, x.above(x.top_nodes))[x.at]
            p = (keep[at] + rest[at] * x.keep)[x.row]
            bits[here] -= np.log2(np.where(x.bit, p, 1 - p))
    return bits


def tree_scores(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """(doc_id, n_bytes, code_bits, bits_per_byte) for every row."""
    spark = docs.sparkSession
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blobs = cut_lineage(keyed_texts(docs).mapInArrow(blob_batches, "blob long, ids array<long>, sizes array<long>, packed binary"))
    length = blobs.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    often = blobs.mapInArrow(lambda b: frequent_batches(b, share), "depth int, context long, n long").groupBy("depth", "context").agg(F.sum("n").alias("n")).filter(F.col("n") >= length / share)
    by_depth: dict[int, list[int]] = {}
    for r in often.select("depth", "context").collect():  # never over `share` of each depth
        by_depth.setdefault(r[0], []).append(r[1])
    hot = {d: np.array(sorted(c), np.int64) for d, c in by_depth.items()}
    grams = blobs.mapInArrow(lambda b: gram_batches(b, n, hot), "bucket int, blob long, grams binary, counts binary")
    grams = cut_lineage(grams.repartition(n // BUCKETS, "bucket").sortWithinPartitions("bucket"))  # stored by bucket: what goes through them twice is shuffled once
    found = grams.mapInArrow(lambda b: (x for t in each_bucket(b) for x in bucket_tops(t, hot).to_batches()), "level int, depth int, node long, value double").groupBy("level", "depth", "node").agg(F.sum("value").alias("value")).toArrow()
    top = spark.sparkContext.broadcast(top_mixture(*(found[c].to_numpy() for c in ("level", "depth", "node", "value"))) if found.num_rows else [])

    def priced(table: pa.Table) -> pa.Table:
        each, all_grams, counts = _merged(table)
        bits = gram_costs(all_grams, counts, top.value, hot).astype(np.float32)
        return pa.table([table["bucket"], table["blob"], pa.array([_packed(bits[np.searchsorted(all_grams, g)]) for g in each], pa.binary())], schema=COSTS)

    def scored(texts: pa.Table, costs: pa.Table) -> pa.Table:
        rows = []
        for row in texts.to_pylist():
            keys, offsets = _blob_grams(row["sizes"], row["packed"])
            distinct, place = np.unique(keys, return_inverse=True)
            order, ends = _buckets(distinct, n, hot)
            bits = np.zeros(len(distinct))
            for bucket, c in zip(costs["bucket"].to_pylist(), costs["costs"].to_pylist(), strict=True):
                bits[order[ends[bucket - 1] if bucket else 0 : ends[bucket]]] = _loose(c, np.float32)
            sums = np.concatenate([[0.0], np.cumsum(bits[place])])
            rows.append(batch_of(SCORES, row["ids"], row["sizes"], sums[offsets[1:]] - sums[offsets[:-1]]))
        return pa.Table.from_batches(rows, schema=SCORES)

    costs = grams.mapInArrow(lambda b: (x for t in each_bucket(b) for x in priced(t).to_batches()), "bucket int, blob long, costs binary")
    scores = blobs.groupBy("blob").cogroup(costs.groupBy("blob")).applyInArrow(scored, "doc_id long, n_bytes long, code_bits double")
    return scores.withColumn("bits_per_byte", F.expr("code_bits / nullif(n_bytes, 0)"))
