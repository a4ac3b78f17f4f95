"""Operator 5, approximate nearest neighbours: a vantage-point tree in each shard, searched by a stated set of queries.

Queries are the vectors whose id is divisible by EVERY, against all vectors. Copies of a vector are one point with the few least ids that
can be among somebody's nearest, so a vector that a third of all rows repeat costs no more than another.

A node splits its points at the median distance from a vantage point. A search that has a k-th best distance r leaves out a side whose
points are all farther from the vantage point, or nearer to it, than the query by more than r / relax: by the triangle inequality
relax = 1 leaves out nothing that counts, so the search is exact; a larger factor prunes more. The uppermost levels of the tree are
fitted on at most SAMPLE points (parameter `sample`) and broadcast; all points are routed by them to regions, and a region is divided by
a hash into shards of about SHARD_ROWS points, each of which gets a tree of its own, built once and stored with the points as they came
(float32 for float columns). A query first searches one shard of its own region; with the distance found there it is sent, by the same
inequality, only to the regions that may hold something nearer. A shard meets its queries in blocks of about QUERY_ROWS, so what a task
holds is bounded, and the lists from all shards are merged by a window over k + 1 rows of each.

Distances are Euclidean between unit vectors, so the order is that of cosine.

Defined results: rows with a null id, or a vector that is null, empty, all zero or not finite, are left out; vectors meet only those of
their own dimension, however long; repeated rows of one id are one vector; a vector is not its own neighbour, its copies are (at distance 0); ties
go to the lesser id; with fewer than k others all are returned; an empty table gives an empty result; extra columns are ignored,
also those whose names differ from a needed one's in case alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage
from .vectors import block_of, by_dimension, distinct_vectors, matrix, sample_rows, unit_rows, usable

K, RELAX, EVERY, SAMPLE, SHARD_ROWS, QUERY_ROWS, LEAF = 10, 2.0, 100, 16_384, 8192, 4096, 64
SLACK = 1e-7  # of rounding, which is this much for the distance of a vector from itself


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class Tree:
    """A vantage-point tree as arrays: points in an order in which each node has a run of them, its vantage point first.

    near[n] is -1 for a leaf; else the run of near[n] follows the vantage point, and that of far[n] comes after it.
    """

    def __init__(self, x: np.ndarray, leaf: int):
        self.order, self.lo, self.hi, self.radius, self.near, self.far = np.arange(len(x)), [], [], [], [], []
        todo = [(0, len(x), -1, False)]
        while todo:
            lo, hi, above, is_far = todo.pop()
            n = len(self.lo)
            if above >= 0:
                (self.far if is_far else self.near)[above] = n
            self.lo.append(lo), self.hi.append(hi), self.radius.append(0.0), self.near.append(-1), self.far.append(-1)
            if hi - lo <= leaf:
                continue
            rows = self.order[lo:hi]
            d = distances(x[rows[:1]], x[rows[1:]])[0]
            radius = float(np.median(d))
            inside = d < radius
            if 8 * inside.sum() < len(d):  # most are at one distance: little to split by
                continue
            self.order[lo + 1 : hi] = np.concatenate([rows[1:][inside], rows[1:][~inside]])
            self.radius[n], middle = radius, lo + 1 + int(inside.sum())
            todo += [(lo + 1, middle, n, False), (middle, hi, n, True)]

    def packed(self) -> bytes:
        return np.array([self.lo, self.hi, self.radius, self.near, self.far], np.float64).tobytes()


class Top:
    """The uppermost levels, fitted on a sample: routes points to regions, and says how near to a query a region can be."""

    def __init__(self, x: np.ndarray, regions: int):
        t = Tree(x, max(2, -(-len(x) // max(regions, 1)))) if len(x) else None
        self.x, self.tree = (x[t.order] if t else x), t
        self.regions, todo = [], [(0, [])] if t else []
        while todo:
            n, path = todo.pop()
            if t.near[n] < 0:
                self.regions.append(path)
            else:
                todo += [(t.near[n], [*path, (n, True)]), (t.far[n], [*path, (n, False)])]
        self.nodes = sorted({n for path in self.regions for n, _ in path})
        self.vantage = x[:0] if t is None else self.x[[t.lo[n] for n in self.nodes]]
        self.radius = np.array([t.radius[n] for n in self.nodes]) if t else np.zeros(0)
        slot = {n: k for k, n in enumerate(self.nodes)}
        self.paths = [[(slot[n], inside) for n, inside in path] for path in self.regions]
        self.x = self.tree = self.regions = None

    def nearest_possible(self, q: np.ndarray) -> np.ndarray:
        """(queries, regions): a bound that is at most 0 for a query's own region only."""
        out = np.full((len(q), max(1, len(self.paths))), -np.inf)
        d = distances(q, self.vantage) - self.radius if len(self.nodes) else np.zeros((len(q), 0))
        for r, path in enumerate(self.paths):
            for slot, inside in path:
                np.maximum(out[:, r], d[:, slot] if inside else -d[:, slot], out=out[:, r])
        return out

    def region(self, x: np.ndarray) -> np.ndarray:
        """Where a point belongs: nearer than the radius is inside."""
        at = np.zeros(len(x), np.int32)
        if len(self.nodes):
            inside = distances(x, self.vantage) < self.radius
            for r, path in enumerate(self.paths):
                fits = np.ones(len(x), bool)
                for slot, near in path:
                    fits &= inside[:, slot] == near
                at[fits] = r
        return at


class Search:
    """The `keep` nearest of a shard's (point, id) for each query, as distances and ids; ids -1 where there are fewer.

    bound: what distance a query knows of already; it is only there to prune.
    """

    def __init__(self, tree: np.ndarray, x: np.ndarray, ids: np.ndarray, owner: np.ndarray, q: np.ndarray, bound: np.ndarray, keep: int, relax: float):
        self.lo, self.hi, self.radius, self.near, self.far = tree[0].astype(int), tree[1].astype(int), tree[2], tree[3].astype(int), tree[4].astype(int)
        self.x, self.ids, self.first, self.q, self.relax, self.keep = x, ids, owner, q, relax, keep
        self.best = np.full((len(q), keep), np.inf)
        self.who = np.full((len(q), keep), -1, np.int64)
        self.bound, self.compared = bound, 0
        if len(q):
            self._visit(0, np.arange(len(q)))

    def _reach(self, at: np.ndarray) -> np.ndarray:
        return np.minimum(self.best[at, -1], self.bound[at])

    def _offer(self, at: np.ndarray, d: np.ndarray, lo: int, hi: int) -> None:
        better = (d <= self._reach(at)[:, None] + SLACK).any(1)
        if not better.any():
            return
        at, d = at[better], d[better]
        width = min(self.keep, d.shape[1])
        if d.shape[1] > width:
            limit = np.partition(d, width - 1, axis=1)[:, [width - 1]]
            width = int((d <= limit).sum(1).max())
            pick = np.argpartition(d, min(width, d.shape[1]) - 1, axis=1)[:, :width]
            d = np.take_along_axis(d, pick, 1)
        else:
            pick = np.broadcast_to(np.arange(d.shape[1]), d.shape)
        counts = np.diff(self.first[lo : hi + 1])
        most = int(counts.max())
        for c in range(most):  # the c-th least id of each point
            has = counts[pick] > c
            if not has.any():
                break
            who = np.where(has, self.ids[np.minimum(self.first[lo + pick] + c, len(self.ids) - 1)], -1)
            dist = np.hstack([self.best[at], np.where(has, d, np.inf)])
            ids = np.hstack([self.who[at], who])
            order = np.lexsort((ids, dist), axis=1)[:, : self.keep]
            self.best[at], self.who[at] = np.take_along_axis(dist, order, 1), np.take_along_axis(ids, order, 1)

    def _visit(self, n: int, at: np.ndarray) -> None:
        if not len(at):
            return
        lo, hi = self.lo[n], self.hi[n] if self.near[n] < 0 else self.lo[n] + 1
        d = distances(self.q[at], self.x[lo:hi])
        self.compared += d.size
        self._offer(at, d, lo, hi)
        if self.near[n] < 0:
            return
        d, radius = d[:, 0], self.radius[n]
        inside = d < radius
        self._visit(self.near[n], at[inside])
        self._visit(self.far[n], at[~inside])
        reach = self._reach(at) / self.relax + SLACK
        self._visit(self.far[n], at[inside & (radius - d <= reach)])
        self._visit(self.near[n], at[~inside & (d - radius <= reach)])


SHARD = "dim int, region int, shard int, n int, ids binary, first binary, vectors binary, tree binary"
ASKING = "dim int, region int, node long, bound double, vector binary"
FOUND = "node long, neighbour_id long, distance double"


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and len+1 offsets into them."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(np.int64)


def nearest(embeddings: DataFrame, k: int = K, relax: float = RELAX, every: int = EVERY, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): for each vector with an id divisible by `every` its k nearest others, rank 1 the nearest."""
    spark = embeddings.sparkSession
    member, nodes = distinct_vectors(usable(embeddings), k + 1)
    asked = cut_lineage(member.filter(F.pmod("vec_id", F.lit(every)) == 0))
    drawn = by_dimension(sample_rows(nodes, sample))
    regions = max(1, -(-nodes.count() // shard_rows))
    kind = np.float32 if nodes.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    tops = spark.sparkContext.broadcast({d: Top(x, min(regions, max(1, len(x) // 32))) for d, x in drawn.items()})
    none = Top(np.zeros((0, 1)), 1)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, region = b.column(1).to_numpy(), np.zeros(b.num_rows, np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                region[at] = tops.value.get(int(d), none).region(unit_rows(matrix(b.column(3).take(pa.array(at)))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(region)], names=["node", "dim", "ids", "embedding", "region"])

    vector = nodes.schema["embedding"].dataType.simpleString()
    placed = cut_lineage(nodes.select("node", "dim", "ids", "embedding").mapInArrow(routed, f"node long, dim int, ids array<long>, embedding {vector}, region int"))
    sizes = cut_lineage(placed.groupBy("dim", "region").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("shards")))
    spread = placed.join(sizes, ["dim", "region"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))

    def grown(group: pa.Table) -> pa.Table:
        raw = matrix(group["embedding"])
        tree = Tree(unit_rows(raw), LEAF)
        ids, first = _lists(group["ids"].take(pa.array(tree.order)))
        cell = {c: [group[c][0].as_py()] for c in ("dim", "region", "shard")}
        return pa.table({**cell, "n": [len(raw)], "ids": [ids.tobytes()], "first": [first.tobytes()], "vectors": [raw[tree.order].astype(kind).tobytes()], "tree": [tree.packed()]}, schema=pa.schema([("dim", pa.int32()), ("region", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "first", "vectors", "tree"))]))

    shards = cut_lineage(spread.select("dim", "region", "shard", "ids", "embedding").groupBy("dim", "region", "shard").applyInArrow(grown, SHARD))

    def searched(table: pa.Table, queries: pa.Table) -> tuple[np.ndarray, Search]:
        row = {c: table[c][0].as_py() for c in ("dim", "ids", "first", "vectors", "tree")}
        x = unit_rows(np.frombuffer(row["vectors"], kind).reshape(-1, row["dim"]))
        q = unit_rows(np.frombuffer(b"".join(queries["vector"].to_pylist()), kind).reshape(-1, row["dim"]))
        tree = np.frombuffer(row["tree"]).reshape(5, -1)
        return queries["node"].to_numpy(), Search(tree, x, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["first"], np.int64), q, queries["bound"].to_numpy(), k + 1, relax)

    wire = lambda rows: [v.astype(kind).tobytes() for v in rows]
    asking = placed.join(asked.select("node").distinct(), "node").select("dim", "region", "node", F.lit(float("inf")).alias("bound"), "embedding")

    def raw_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([np.array(v, kind).tobytes() for v in b.column(4).to_pylist()], pa.binary())], names=["dim", "region", "node", "bound", "vector"])

    own = cut_lineage(asking.mapInArrow(raw_queries, ASKING))

    def met(queries: DataFrame, all_shards: bool) -> DataFrame:
        """(dim, region, shard, block, ..): queries at the shards they are to search, and the shards once for each block of queries."""
        blocks = queries.groupBy("dim", "region").agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("int").alias("blocks"))
        where = sizes.join(blocks, ["dim", "region"])
        each = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)) if all_shards else F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
        left = queries.join(where, ["dim", "region"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")).withColumn("shard", each).select("dim", "region", "shard", "block", "node", "bound", "vector")
        right = shards.join(blocks, ["dim", "region"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return right.groupBy("dim", "region", "shard", "block").cogroup(left.groupBy("dim", "region", "shard", "block"))

    def bounded(table: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("node", pa.int64()), ("bound", pa.float64())])
        if not (table.num_rows and queries.num_rows):
            return schema.empty_table()
        node, found = searched(table, queries)
        return pa.table([node, found.best[:, -1]], schema=schema)

    first = met(own, False).applyInArrow(bounded, "node long, bound double")
    known = own.drop("bound").join(first, "node", "left").select("dim", "node", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), "vector")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, bound = b.column(0).to_numpy(), b.column(2).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                top = tops.value.get(int(d), none)
                for some in np.array_split(at, max(1, len(at) // 1024)):
                    q = unit_rows(np.frombuffer(b"".join(b.column(3).take(pa.array(some)).to_pylist()), kind).reshape(-1, d))
                    i, region = np.nonzero(top.nearest_possible(q) <= (bound[some] / relax + SLACK)[:, None])
                    rows = b.take(pa.array(some[i]))
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(region.astype(np.int32)), rows.column(1), rows.column(2), rows.column(3)], names=["dim", "region", "node", "bound", "vector"])

    there = cut_lineage(known.mapInArrow(sent, ASKING))

    def listed(table: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("node", pa.int64()), ("neighbour_id", pa.int64()), ("distance", pa.float64())])
        if not (table.num_rows and queries.num_rows):
            return schema.empty_table()
        node, found = searched(table, queries)
        some = found.who >= 0
        return pa.table([np.repeat(node, some.sum(1)), found.who[some], found.best[some]], schema=schema)

    lists = met(there, True).applyInArrow(listed, FOUND)
    rank = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("distance", "neighbour_id"))
    best = lists.withColumn("r", rank("node")).filter(F.col("r") <= k + 1).drop("r")
    others = asked.join(best, "node").filter("vec_id <> neighbour_id").withColumn("distance", F.when(F.col("distance") < SLACK, F.lit(0.0)).otherwise(F.col("distance")))
    return others.withColumn("rank", rank("vec_id")).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "distance")
