"""Operator 2, substring dedup by sparse suffix arrays: only suffixes at content-selected minimiser positions are sorted.

A position is kept when the hash of its `K` bytes is the least in some window of `WINDOW` positions, so two equal passages of
WINDOW + K - 1 bytes or more keep the same places whatever stands around them. Suffixes that agree in their first `HEAD` bytes are one
class; those whose HEAD bytes (by a 64-bit hash) occur nowhere else, or that are shorter, leave before any text is moved. Counting the
classes says how many suffixes each has. The others are sorted by their HEAD
bytes, neighbours are compared byte by byte, and a run of equal ones is a class. Each member is then extended byte by byte to the right and to the
left against the class's first suffix. A class of more than SPLIT suffixes is divided by a hash into as many shards as it takes, each with a copy
of the first, so a passage that a third of all rows hold is many tasks with the same result.

How far: of an equal stretch [s, e) of a text and a first holder, the leftmost kept place is within WINDOW of s, and the rightmost whose
HEAD bytes are still inside is within WINDOW + HEAD of e; LEFT and RIGHT bytes around a suffix, which are these sums, hold all that is
to be compared. So each piece reaches exactly to where the member and its first holder differ, a chain of pieces covers a passage of any
length, and every repeat of WINDOW + K - 1 + HEAD bytes is found.

What to keep: a piece is kept where it is the class's first suffix itself, and is a copy of first_doc_id elsewhere. Touching pieces make a
span, divided where the first holder or keep changes; where pieces overlap the one that begins first counts. What is cut is thus always in
an earlier document (or earlier in the same), and without what is not kept each passage is still there once.

Defined results: null or empty texts, texts under HEAD bytes and rows whose doc_id is null give no row; very long texts are whole suffixes like
others, a task holds one at a time; rows that repeat (doc_id and text) can't be told apart: what they share is kept in each; different texts
of one doc_id have spans of their own; of equal suffixes the least (doc_id, place, hash of the text) is the first; an empty table gives an empty
result; extra columns are ignored, also those whose names differ from a needed one's in case alone. Where a periodic passage keeps many equal positions, one in WINDOW / 2 bytes stays, counted both from the run's start and from its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, cut_lineage, flat_bytes, keyed_texts, pieces
from .op1_chunks import parts_of

K, WINDOW, HEAD, MIN_SPAN, SPLIT = 24, 100, 100, 120, 4096
LEFT, RIGHT = WINDOW, WINDOW + HEAD
PLACES = pa.schema([("head", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32())])
SUFFIXES = pa.schema([("head", pa.binary()), ("salt", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int32()), ("at", pa.int32()), ("around", pa.binary())])
DICTIONARY, DICTIONARY_TEXTS, DICTIONARY_CUT = 64 << 10, 1000, 4096  # of what moves, compressed: bytes, and how much of how many texts they are made of
BROADCAST_CLASSES = 1_000_000  # divided classes are broadcast up to so many; beyond, the join shuffles
MATCHES = pa.schema([("doc_id", pa.int64()), ("row", pa.int32()), ("at", pa.int32()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("first", pa.int64()), ("keep", pa.bool_())])
SPREAD = 0x9E3779B185EBCA87


def words_of(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number; the last 7 positions have none."""
    words = np.empty(len(data) - 7, np.uint64)
    for s in range(8):
        words[s::8] = np.frombuffer(data[s : s + (len(data) - s) // 8 * 8].tobytes(), np.uint64)
    return words


def seed_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the K = 24 bytes from each of n positions on."""
    with np.errstate(over="ignore"):
        h = words[:n] * np.uint64(SPREAD)
        h ^= h >> np.uint64(29)
        h = (h + words[8 : n + 8]) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
        h = (h + words[16 : n + 16]) * np.uint64(0x165667B19E3779F9)
        return h ^ (h >> np.uint64(32))


def head_hashes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the HEAD bytes from each place on."""
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in [*range(0, HEAD - 7, 8), HEAD - 8]:
            h = (h ^ words[at + k]) * np.uint64(SPREAD)
            h ^= h >> np.uint64(32)
        return h * np.uint64(0xC2B2AE3D27D4EB4F)


def _slide(x: np.ndarray, pick) -> np.ndarray:
    """pick (minimum or maximum) over each WINDOW values in a row."""
    width = 1
    while 2 * width <= WINDOW:
        x = pick(x[:-width], x[width:])
        width *= 2
    rest = WINDOW - width
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def minimisers(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Kept positions in the buffer, which has K + WINDOW bytes after the last text."""
    h = seed_hashes(words, len(data) - K + 1)
    order = (h >> np.uint64(32)).astype(np.uint32)
    low = _slide(order, np.minimum)
    inside = np.zeros(len(low) + 1, np.int32)  # windows whose positions all have their K bytes in one text
    n = np.diff(offsets) - (K + WINDOW - 2)
    np.add.at(inside, offsets[:-1][n > 0], 1)
    np.add.at(inside, (offsets[:-1] + n)[n > 0], -1)
    low[np.cumsum(inside[:-1]) == 0] = 0
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), low, np.zeros(WINDOW - 1, np.uint32)])
    at = np.flatnonzero((order == _slide(padded, np.maximum)) & (order > 0))
    if len(at):
        hashes, row = h[at], np.searchsorted(offsets, at, side="right")
        fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])
        over = np.concatenate([fresh[1:], [True]])
        run = np.cumsum(fresh) - 1
        from_start, from_end = (at - at[fresh][run]) // (WINDOW // 2), (at[over][run] - at) // (WINDOW // 2)
        at = at[fresh | over | np.concatenate([[True], from_start[1:] != from_start[:-1]]) | np.concatenate([from_end[1:] != from_end[:-1], [True]])]
    return at


def place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, 1 << 20):
            data, offsets = flat_bytes(batch.column(1))
            data = np.concatenate([data, np.zeros(K + WINDOW + HEAD, np.uint8)])
            words = words_of(data)
            at = minimisers(data, offsets, words)
            row = np.searchsorted(offsets, at, side="right") - 1
            whole_heads = at + HEAD <= offsets[row + 1]
            at, row = at[whole_heads], row[whole_heads]
            if len(at):
                yield batch_of(PLACES, head_hashes(words, at).view(np.int64), batch.column(0).to_numpy()[row], (at - offsets[row]).astype(np.int32))


def dictionary_of(texts: DataFrame) -> bytes:
    """Common strings for compression, from the beginnings of some texts; what moves is smaller for it, results don't depend on it."""
    some = [r[0].encode() for r in texts.limit(DICTIONARY_TEXTS).select(F.substring("text", 1, DICTIONARY_CUT)).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, [x[k : k + 256] for x in some for k in range(0, len(x), 256)]).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def squeezer(dictionary: bytes, level: int) -> Callable[[bytes], bytes]:
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_dict_id=False).compress


def loosener(dictionary: bytes) -> Callable[[bytes], bytes]:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress


def packed_batches(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the shuffle that brings them to their places."""
    squeeze = squeezer(dictionary, 6)
    for whole in batches:
        for batch in pieces(whole, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "packed"])


def suffix_batches(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """From (doc_id, packed text, places and salts of the doc_id) to suffixes: their HEAD bytes, and what is before and after these, compressed.

    Where texts share a doc_id each has the places of all; a place that is another's is a suffix like any, and counts if its bytes are repeated.
    """
    loosen, squeeze = loosener(dictionary), squeezer(dictionary, 3)
    for whole in batches:
        for batch in pieces(whole.select(["doc_id", "packed", "at", "salt"]), 1 << 19):
            doc = batch.column(0).to_numpy()
            for r, text in enumerate(batch.column(1).to_pylist()):
                data = loosen(text)
                row = np.array([xxhash.xxh3_64_intdigest(data) >> 32], np.uint32).view(np.int32)[0]
                places, salts = batch.column(2)[r].values.to_numpy(), batch.column(3)[r].values.to_numpy()
                inside = places + HEAD <= len(data)
                places, salts = places[inside], salts[inside]
                for s in range(0, len(places), 8192):
                    at, salt = places[s : s + 8192], salts[s : s + 8192]
                    around = [squeeze(data[max(0, p - LEFT) : p] + data[p + HEAD : p + RIGHT]) for p in at.tolist()]
                    yield batch_of(SUFFIXES, [data[p : p + HEAD] for p in at.tolist()], salt, np.full(len(at), doc[r]), np.full(len(at), row), at, around)


def _grid(column: pa.Array, width: int, from_right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of a matrix, counted from their end if from_right, and their lengths."""
    flat, off = flat_bytes(column)
    size = np.diff(off)
    grid = np.zeros((len(size), width), np.uint8)
    cols = np.arange(width)
    grid[(cols >= width - size[:, None]) if from_right else (cols < size[:, None])] = flat
    return (grid[:, ::-1] if from_right else grid), size


def _common(grid: np.ndarray, size: np.ndarray, me: np.ndarray, it: np.ndarray) -> np.ndarray:
    """How many bytes rows `me` and rows `it` have in common."""
    differ = grid[me] != grid[it]
    first = np.where(differ.any(1), differ.argmax(1), grid.shape[1])
    return np.minimum(first, np.minimum(size[me], size[it]))


def neighbour_batches(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes to pieces. The first suffix of a class waits for the members of later batches, with how far they reached."""
    loosen = loosener(dictionary)
    held, reach, more = None, (0, 0), False  # of the open class: its first suffix, the most to the left and right, whether it has another member

    def first_piece(row: pa.RecordBatch, far: tuple[int, int]) -> pa.RecordBatch:
        doc, at = row.column(2).to_numpy(), row.column(4).to_numpy().astype(np.int64)
        return batch_of(MATCHES, doc, row.column(3), row.column(4), at - far[0], at + HEAD + far[1], doc, [True])

    for whole in batches:
        for start in range(0, whole.num_rows, 4096):
            batch = whole.slice(start, 4096)
            rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            n = rows.num_rows
            doc, row, at = rows.column(2).to_numpy(), rows.column(3).to_numpy(), rows.column(4).to_numpy().astype(np.int64)
            heads, sizes = _grid(rows.column(0), HEAD, False)
            salt = rows.column(1).to_numpy()
            opens = np.concatenate([[True], (salt[1:] != salt[:-1]) | (_common(heads, sizes, np.arange(1, n), np.arange(n - 1)) < HEAD)])
            owner = np.flatnonzero(opens)[np.cumsum(opens) - 1]
            me = np.flatnonzero(~opens)
            it = owner[me]
            around, cut = [loosen(x) for x in rows.column(5).to_pylist()], np.minimum(at, LEFT).tolist()
            left = _common(*_grid(pa.array([x[:c] for x, c in zip(around, cut, strict=True)], pa.binary()), LEFT, True), me, it)
            right = _common(*_grid(pa.array([x[c:] for x, c in zip(around, cut, strict=True)], pa.binary()), RIGHT - HEAD, False), me, it)
            far = np.zeros((2, n), np.int64)
            np.maximum.at(far[0], it, left)
            np.maximum.at(far[1], it, right)
            members = np.bincount(it, minlength=n)
            if held is not None:
                far[:, 0] = np.maximum(far[:, 0], reach)
                members[0] += more
            itself = (doc[me] == doc[it]) & (row[me] == row[it]) & (at[me] == at[it])
            yield batch_of(MATCHES, doc[me], row[me], at[me], at[me] - left, at[me] + HEAD + right, doc[it], itself)
            done = np.flatnonzero(opens)[:-1]
            done = done[members[done] > 0]
            yield batch_of(MATCHES, doc[done], row[done], at[done], at[done] - far[0, done], at[done] + HEAD + far[1, done], doc[done], np.ones(len(done), bool))
            last = int(owner[-1])
            held, reach, more = pa.RecordBatch.from_pylist(rows.slice(last, 1).to_pylist(), schema=rows.schema), tuple(far[:, last]), bool(members[last])
    if held is not None and more:
        yield first_piece(held, reach)


def apart(found: DataFrame) -> DataFrame:
    """Overlapping pieces as stretches that don't: where they overlap, the one that begins first counts. Pieces of one place from several shards are one."""
    found = found.repartition("doc_id", "row").groupBy("doc_id", "row", "at", "first", "keep").agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"))
    by = Window.partitionBy("doc_id", "row").orderBy("start_byte", F.desc("end_byte"), F.desc("keep"), "first")
    so_far = F.coalesce(F.max("end_byte").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    return found.withColumn("start_byte", F.greatest("start_byte", so_far)).filter("start_byte < end_byte")


def suffix_dedup(docs: DataFrame, min_span: int = MIN_SPAN, split: int = SPLIT) -> DataFrame:
    """(doc_id, start_byte, end_byte, first_doc_id, keep): the parts of passages that occur more than once; bytes count in UTF-8.

    first_doc_id is the least document that holds the part, and keep says that this is where it holds it first.
    """
    texts = keyed_texts(docs).filter("doc_id is not null and text <> ''")
    dictionary = dictionary_of(texts)
    places = texts.mapInArrow(place_batches, "head long, doc_id long, at int")
    classes = cut_lineage(places.groupBy("head").agg(F.count("*").alias("n")).filter("n > 1").select("head", F.ceil(F.col("n") / F.lit(split)).cast("int").alias("shards")))
    divided = classes.filter("shards > 1").select("head")
    divided = F.broadcast(divided) if divided.count() <= BROADCAST_CLASSES else divided
    firsts = places.join(divided, "head").groupBy("head").agg(F.min(F.struct("doc_id", "at")).alias("first"))  # in one shard the first is found by sorting
    is_first = F.struct("doc_id", "at") == F.col("first")
    one = F.array(F.pmod(F.xxhash64("doc_id", "at"), F.col("shards")).cast("int"))
    told = classes.join(firsts, "head", "left")
    salted = places.join(told, "head").select("doc_id", "at", F.explode(F.when(is_first, F.sequence(F.lit(0), F.col("shards") - 1)).otherwise(one)).alias("salt"))
    wanted = salted.groupBy("doc_id").agg(F.collect_set(F.struct("at", "salt")).alias("places")).select("doc_id", F.col("places.at").alias("at"), F.col("places.salt").alias("salt"))
    packed = texts.mapInArrow(lambda b: packed_batches(b, dictionary), "doc_id long, packed binary")
    suffixes = packed.join(wanted, "doc_id").select("doc_id", "packed", "at", "salt").mapInArrow(lambda b: suffix_batches(b, dictionary), "head binary, salt int, doc_id long, row int, at int, around binary")
    sorted_ = suffixes.repartition(F.xxhash64("head", "salt")).sortWithinPartitions("head", "salt", "doc_id", "at", "row")
    pieces_ = sorted_.mapInArrow(lambda b: neighbour_batches(b, dictionary), "doc_id long, row int, at int, start_byte long, end_byte long, first long, keep boolean")
    return parts_of(apart(pieces_), [], min_span, ["doc_id", "row"]).select("doc_id", "start_byte", "end_byte", "first_doc_id", "keep")
