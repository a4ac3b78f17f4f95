"""Operator 6, embedding near-dedup: int8 tile products with error bounds, full precision only where they leave doubt.

Each unit vector x is written as s * q + e: q in int8, s its scale, |e| known. For two of them

    | x . y - s_x s_y (q_x . q_y) | <= |s_x q_x| |e_y| + |s_y q_y| |e_x| + |e_x| |e_y|

so a pair whose int8 product plus this bound is under the threshold is certainly under it, and one whose product less the bound reaches
the threshold is certainly a pair. What is between is computed again from the full vectors. The integers go through the matrix product
as float32, which is exact: a sum of dim * 127 ** 2 stays under 2 ** 24 up to dim 1040, and longer vectors are summed in slices of 1024.

Which tiles are computed: vectors belong to the nearest of some centres, fitted on at most SAMPLE of them (parameter `sample`), and those of
a cell to blocks of at most about BLOCK_ROWS, by their angle from the centre and, where many have the same, by a hash. If two vectors are
within the angle t of the threshold, y is in a block of cell B and x is at the angle a from its own centre, then x is at most a + 2t from
B's centre, and no more than t nearer or farther than the block's members are. Two blocks meet where this may hold both ways, and then
only with the rows for which it does, so no pair is lost, and each two blocks meet once.

A vector is stored twice, as it came and in its block, and shuffled once, into its block. Blocks meet by a Cartesian product of the stored
blocks' partitions, which reads them again for each other partition and writes nothing, so disk follows the input, whatever the vectors
are like; reading and work may grow with its square.

Copies of a vector are one class. A task adds up what its tiles say: for each class that has a link in them, how many vectors it is linked
to, and the least class of its component. Links are counted and components joined over these rows; no list of pairs is made.

Defined results: one row for every usable vector, also without links; rows with a null id, or a vector that is null, empty, all zero or
not finite, are left out; vectors meet only those of their own dimension, however long; repeated rows of one id are one vector; pairs at the
threshold count; an empty table gives an empty result; extra columns are ignored, also those whose names differ from a needed one's in
case alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut_lineage, give_back
from .graph import components
from .vectors import block_of, by_dimension, matrix, sample_rows, stored_vectors, unit_rows

THRESHOLD, SAMPLE, CELL_ROWS, MOST_CELLS, BLOCK_ROWS, SLICE = 0.95, 16_384, 1024, 2048, 2048, 1024
BINS, BLOCK_BYTES, PART_BYTES, PARTS = 64, 8 << 20, 48 << 20, 16  # PARTS: of the stored blocks at least, where there are as many
ROUNDING, TURN, LOOK = 1e-9, 1e-6, 1e-5  # of products, of angles, and of a first look in float32
BLOCKS = pa.schema([("number", pa.int32()), ("dim", pa.int32()), ("cell", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("near", pa.list_(pa.float32())), ("ids", pa.binary()), ("counts", pa.binary()), ("vectors", pa.binary())])
LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """q in int8, the scales, the norms of s * q and of what it leaves out."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None])
    kept = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(kept, axis=1), np.linalg.norm(x - kept, axis=1)


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: float32 where the sums are short enough, else slices added up in float64."""
    if a.shape[1] <= SLICE:
        return a.astype(np.float32) @ b.astype(np.float32).T
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], SLICE):
        out += a[:, at : at + SLICE].astype(np.float32) @ b[:, at : at + SLICE].astype(np.float32).T
    return out


def tile(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of a and of b of the pairs at or over the threshold, and how many were computed again.

    A first look compares each row's products with what the row's largest bound leaves of the threshold; the pair's own bound is for the few that pass.
    """
    qa, sa, na, ea = quantised(a)
    qb, sb, nb, eb = quantised(b)
    rows, cols, again = [], [], 0
    least = (threshold - (na * eb.max() + (nb + eb).max() * ea) - LOOK) / sa
    for at in range(0, len(a), 512):
        product = integer_products(qa[at : at + 512], qb)
        look = product * sb.astype(np.float32) >= least[at : at + 512, None].astype(np.float32)
        if same:
            look &= np.arange(len(b)) > np.arange(at, at + len(product))[:, None]
        i, j = np.nonzero(look)
        value, i = product[i, j].astype(np.float64), i + at
        value *= sa[i] * sb[j]
        bound = na[i] * eb[j] + (nb[j] + eb[j]) * ea[i] + ROUNDING
        keep, doubt = value - bound >= threshold, (value + bound >= threshold) & (value - bound < threshold)
        unsure = np.flatnonzero(doubt)
        again += len(unsure)
        for k in range(0, len(unsure), 1 << 16):
            p = unsure[k : k + (1 << 16)]
            keep[p] = np.einsum("ij,ij->i", a[i[p]], b[j[p]]) >= threshold
        rows.append(i[keep].astype(np.int32)), cols.append(j[keep].astype(np.int32))
    return np.concatenate(rows), np.concatenate(cols), again


def least_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n things the first of its component, by links i - j."""
    low = np.arange(n)
    while len(i):
        new = low.copy()
        both = np.minimum(low[i], low[j])
        np.minimum.at(new, i, both)
        np.minimum.at(new, j, both)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def centres_of(x: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Unit centres by spherical k-means from evenly drawn rows; an empty cell keeps its centre."""
    c = x[:: max(1, len(x) // cells)][:cells]
    for _ in range(rounds):
        own = np.concatenate([(part @ c.T).argmax(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def planned(seen: pa.Table, block_rows: int, width: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Blocks for rows counted by (dim, cell, bin): for each dimension its cells' bins' first block and number of blocks, -1 and 0 in cells without rows; the blocks' dimensions, cells and bytes.

    Neighbouring bins share a block while they fit; a bin that doesn't fit has blocks of its own.
    """
    order = np.lexsort([seen[c].to_numpy() for c in ("bin", "cell", "dim")])
    dims, cells, bins, rows = (seen[c].to_numpy()[order] for c in ("dim", "cell", "bin", "rows"))
    blocks: list[list[float]] = []
    where: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in np.unique(dims).tolist():
        most = min(block_rows, max(64, BLOCK_BYTES // (d * width)))
        mine = np.flatnonzero(dims == d)
        first, parts = np.full((int(cells[mine].max()) + 1, BINS), -1, np.int32), np.zeros((int(cells[mine].max()) + 1, BINS), np.int32)
        at, held = -1, most
        for c, k, n in zip(cells[mine].tolist(), bins[mine].tolist(), rows[mine].tolist(), strict=True):
            if c == at and held + n <= most:
                held += n
                blocks[-1][2] += n * d * width
                first[c, k], parts[c, k] = len(blocks) - 1, 1
            else:
                many = -(-n // most)
                first[c, k], parts[c, k] = len(blocks), many
                blocks += [[d, c, n * d * width / many] for _ in range(many)]
                at, held = c, n if many == 1 else most
        for f, p in zip(first, parts, strict=True):  # a row that rounding puts in a bin without rows goes where a neighbouring bin goes
            if len(there := np.flatnonzero(p)):
                to = there[np.abs(np.arange(BINS)[:, None] - there).argmin(1)]
                f[:], p[:] = f[to], p[to]
        where[d] = first, parts
    out = np.array(blocks, np.float64).reshape(-1, 3)
    return where, out[:, 0].astype(np.int32), out[:, 1].astype(np.int32), out[:, 2]


def summed(said: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (node, links, low) as one for each node that occurs: its links added up, low the least node of its component."""
    node, links, low = (np.concatenate(x) for x in zip(*said, strict=True))
    known, at = np.unique(np.concatenate([node, low]), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, at[: len(node)], links)
    return known, total, known[least_linked(len(known), at[: len(node)], at[len(node) :])]


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, class_id, n_links, group_id) for every vector.

    class_id is the least id with the same vector, n_links the number of other vectors whose cosine is at least the threshold, copies
    among them, and group_id the least id that links lead to.
    """
    spark = embeddings.sparkSession
    member, nodes = stored_vectors(embeddings)
    kind = np.float32 if nodes.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    known = nodes.count()
    cells = max(1, min(MOST_CELLS, known // cell_rows))
    share = min(1.0, (1.25 * sample + 100) / max(1, known))  # of the hashes that the sample is sought among: each task would send the driver as many rows as a sample has
    drawn = by_dimension(sample_rows(nodes.filter(F.xxhash64("node") <= int(share * (2**64 - 2**12)) - 2**63), sample))
    centres = spark.sparkContext.broadcast({d: centres_of(x, min(cells, max(1, len(x) // 8))) for d, x in drawn.items()})
    near = acos(max(-1.0, min(1.0, threshold))) + TURN

    def turns(x: np.ndarray, d: int) -> np.ndarray:
        """Angles from the dimension's centres; a dimension that the sample hasn't is one cell, all of it at the angle nought."""
        return angles(x, centres.value[d]) if d in centres.value else np.zeros((len(x), 1))

    def parts(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For some rows of one dimension at a time: the dimension, the rows, their full vectors, their angles from the centres."""
        dims = b["dim"].to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            for some in np.array_split(at, max(1, len(at) // 2048)):
                raw = matrix(b["embedding"].take(pa.array(some)))
                yield int(d), some, raw, turns(unit_rows(raw), int(d))

    def shell(turn: np.ndarray) -> np.ndarray:
        return np.minimum((turn * (BINS / pi)).astype(np.int64), BINS - 1)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, _, _, turn in parts(b):
                there, n = np.unique(turn.argmin(1) * BINS + shell(turn.min(1)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(there), pa.int32()), pa.array((there // BINS).astype(np.int32)), pa.array((there % BINS).astype(np.int32)), pa.array(n)], names=["dim", "cell", "bin", "rows"])

    narrow = nodes.select("node", "n", "dim", "embedding")
    seen = narrow.mapInArrow(homes, "dim int, cell int, bin int, rows long").groupBy("dim", "cell", "bin").agg(F.sum("rows").alias("rows")).toArrow()  # never over BINS times the cells, and one for each dimension that the sample hasn't
    where, dim_of, cell_of, filled = planned(seen, block_rows, np.dtype(kind).itemsize)
    pieces = max(1, min(len(filled), max(PARTS, int(-(-filled.sum() // PART_BYTES)))))
    part_of = np.minimum((np.cumsum(filled) - filled) * pieces // max(1.0, filled.sum()), pieces - 1).astype(np.int32)
    plan = spark.sparkContext.broadcast((where, dim_of, cell_of, part_of))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _, _, part_of = plan.value
        for b in batches:
            for d, some, raw, turn in parts(b):
                first, count = where[d]
                turn = np.where((first[:, 0] < 0)[None, :], np.inf, turn[:, : len(first)])
                home, bin_ = turn.argmin(1), shell(turn.min(1))
                number = first[home, bin_] + block_of(b["node"].take(pa.array(some)).to_numpy(), count[home, bin_])
                yield pa.RecordBatch.from_arrays([pa.array(part_of[number]), pa.array(number), b["node"].take(pa.array(some)), b["n"].take(pa.array(some)), pa.array([v.tobytes() for v in raw.astype(kind)], pa.binary())], names=["part", "number", "node", "n", "vector"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, dim_of, cell_of, _ = plan.value
        if not (held := [b for b in batches if b.num_rows]):
            return
        rows = pa.Table.from_batches(held)
        numbers = rows["number"].to_numpy()
        order = np.argsort(numbers, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1):
            some, number = rows.take(pa.array(at)), int(numbers[at[0]])
            d, cell, wire = int(dim_of[number]), int(cell_of[number]), b"".join(some["vector"].to_pylist())
            least, lo, hi = np.inf, np.inf, 0.0
            for raw in np.array_split(np.frombuffer(wire, kind).reshape(-1, d), max(1, len(at) // 1024)):
                turn = turns(unit_rows(raw), d)
                own = turn[:, cell]
                least, lo, hi = np.minimum(least, np.where(turn <= own[:, None] + 2 * near, turn, np.inf).min(0)), min(lo, float(own.min())), max(hi, float(own.max()))
            yield batch_of(BLOCKS, [number], [d], [cell], [lo], [hi], [least.astype(np.float32)], [some["node"].to_numpy().tobytes()], [some["n"].to_numpy().tobytes()], [wire])

    spread = narrow.mapInArrow(placed, "part int, number int, node long, n long, vector binary").repartitionById(pieces, F.col("part"))
    blocks = cut_lineage(spread.mapInArrow(packed, "number int, dim int, cell int, lo double, hi double, near array<float>, ids binary, counts binary, vectors binary"))
    a, b = (blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in BLOCKS.names)) for side in "ab")
    may = (F.col("a_number") <= F.col("b_number")) & (F.col("a_dim") - F.col("b_dim") == 0) & (F.get("a_near", F.col("b_cell")) <= F.col("b_hi") + near) & (F.get("b_near", F.col("a_cell")) <= F.col("a_hi") + near)
    wanted = [f"{side}_{c}" for side in "ab" for c in BLOCKS.names if c != "near"]
    meets = a.join(b.hint("shuffle_replicate_nl"), may).select(*wanted)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows, most, first = 0, 1 << 20, (-1,)

        def block(batch: pa.RecordBatch, k: int, side: str) -> tuple:
            number, d, cell, lo, hi = (batch[f"{side}_{c}"][k].as_py() for c in ("number", "dim", "cell", "lo", "hi"))
            ids, n, raw = (np.frombuffer(batch[f"{side}_{c}"][k].as_buffer(), t) for c, t in (("ids", np.int64), ("counts", np.int64), ("vectors", kind)))
            x = unit_rows(raw.reshape(-1, d))
            return number, d, cell, lo, hi, ids.copy(), n.copy(), x

        def towards(one: tuple, other: tuple) -> np.ndarray:
            """The rows of one block that may have links in another."""
            _, d, cell, *_, x = one
            if d not in centres.value:
                return np.arange(len(x))
            own, turn = angles(x, centres.value[d][[cell, other[2]]]).T
            return np.flatnonzero((turn <= own + 2 * near) & (turn <= other[4] + near) & (turn >= other[3] - near))

        for batch in batches:
            for k in range(batch.num_rows):
                if batch["a_number"][k].as_py() != first[0]:
                    first = block(batch, k, "a")
                if same := batch["b_number"][k].as_py() == first[0]:
                    other, p = first, np.arange(len(first[5]))
                    q = p
                else:
                    other = block(batch, k, "b")
                    p, q = towards(first, other), towards(other, first)
                if not len(p) or not len(q):
                    continue
                i, j, _ = tile(first[7][p], other[7][q], threshold, same)
                if not len(i):
                    continue
                ids, n = (first[5], first[6]) if same else (np.concatenate([first[5][p], other[5][q]]), np.concatenate([first[6][p], other[6][q]]))
                j = j if same else j + len(p)
                links = np.rint(np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))).astype(np.int64)
                order = np.argsort(ids, kind="stable")  # the first of a component is to be its least id
                rank = np.empty(len(ids), np.int64)
                rank[order] = np.arange(len(ids))
                low = ids[order][least_linked(len(ids), rank[i], rank[j])[rank]]
                some = links > 0
                said.append((ids[some], links[some], low[some]))
                rows += int(some.sum())
                if rows > most:
                    said = [summed(said)]
                    rows, most = len(said[0][0]), max(1 << 20, 2 * len(said[0][0]))
        if said:
            out = summed(said)
            for at in range(0, len(out[0]), 1 << 16):
                yield batch_of(LINKS, *(x[at : at + (1 << 16)] for x in out))
        give_back()

    said = cut_lineage(meets.mapInArrow(products, "node long, links long, low long").repartition("node"))  # else a file for each two partitions of blocks
    roots = components(said.select(F.col("node").alias("a"), F.col("low").alias("b")))
    linked = said.groupBy("node").agg(F.sum("links").alias("links")).join(roots, "node", "left")
    return member.join(linked, "node", "left").select("vec_id", F.col("node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("group_id"))
