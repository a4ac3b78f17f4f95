"""Operator 7, BPE encoding and decoding by a tokenization automaton.

The automaton (Berglund and van der Merwe, 2024) accepts exactly the token sequences that BPE produces. It starts with one state and
an arc to itself for each byte; each merge (a, b) -> ab, in order, is a gadget: the state that arc a leads to is copied without its
arc b, arc a now leads to the copy, and wherever arc a exists an arc ab is added that leads where b led. All arcs with one label
lead to one state, so the label is the state, and the automaton is deterministic: a state has at most one arc of a label.

While it is built, a state's arcs are what was cut from it and when. Compiled, they are a table. A merge of a and b at rank r cuts b's
descendants to the left (labels that begin with b, made no earlier than r, and b) from a's descendants to the right (labels that end
with a, made later than r, and a). With labels numbered in the order of a walk through the tree of left parts, latest child first, the
first are a run of numbers, and so are the second in the tree of right parts. So a row of the table, a state, holds the runs of labels that
have no arc there, and whether an arc exists is one search in a short row. The table is compiled once, on the driver, and broadcast: its size
is that of the vocabulary.

Encoding: pre-split words are walked from left to right, all new words of a batch side by side; of the labels that end at a byte, found in
a trie of reversed labels, exactly one has an arc from the state before it, and the walk's arc labels are the tokens. Encoded words are kept for when they come again.
Decoding emits the arc labels' bytes.

Defined results: null texts count as empty and have no tokens; a null doc_id is kept; long words without any space are walked like
others, in time proportional to their length, and very long texts are encoded whole; repeated rows are encoded each; an empty table gives an empty result; extra columns are
ignored, also those whose names differ from a needed one's in case alone. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, picked, pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
SPLIT = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NEVER = 1 << 60
CELLS, LONG = 1 << 18, 256  # bytes of words that go through the table together, and of one that goes by itself
MOST_WORDS = 150_000  # kept in a worker; then it begins anew
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


def printable_bytes() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: this gives the byte back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Table:
    """The compiled automaton: arrays alone, as they are broadcast.

    runs and run_ends: sorted by (state's place << 32 | first place that has no arc there), how far such places reach up to here; places: of each label as a state
    and as an arc; keys, nodes, last: the trie of reversed labels.
    """

    def __init__(self, runs: np.ndarray, run_ends: np.ndarray, places: np.ndarray, keys: np.ndarray, nodes: np.ndarray, last: np.ndarray, labels: dict[int, bytes]):
        self.runs, self.run_ends, self.places, self.keys, self.nodes, self.last = runs, run_ends, places, keys, nodes, last
        self.labels = [labels.get(i, b"") for i in range(max(labels) + 1)]
        self.size = np.array([len(x) for x in self.labels])
        self.digest = xxhash.xxh3_64_intdigest(b"".join(x.tobytes() for x in (runs, run_ends, places, keys, nodes, last)) + b"\0".join(self.labels))
        self.scalar: tuple | None = None

    def _scalars(self) -> tuple:
        """The same for one step at a time: the trie as a dictionary, and each state's runs."""
        if self.scalar is None:
            row = self.runs >> 32
            self.scalar = (dict(zip(self.keys.tolist(), self.nodes.tolist(), strict=True)), array("i", (self.runs & 0xFFFFFFFF).astype(np.int32).tobytes()), array("i", self.run_ends.tobytes()), np.searchsorted(row, np.arange(int(self.places.max(initial=0)) + 2)).tolist(), self.last.tolist(), self.places.tolist())
        return self.scalar

    def follows(self, u: int, v: int) -> bool:
        """Whether state u has an arc v."""
        _, starts, ends, first, _, places = self._scalars()
        row, at = places[0][u], places[1][v]
        k = bisect_right(starts, at, first[row], first[row + 1])
        return k == first[row] or ends[k - 1] <= at

    def encode(self, word: bytes) -> list[int]:
        return self.encode_all([word])[0].tolist()

    def encode_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words in a row, and how many each has. Words of like length go together through the table, one byte of all at a time."""
        counts, order = np.zeros(len(words), np.int64), sorted(range(len(words)), key=lambda k: -len(words[k]))
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(order) and len(words[order[at]]) > LONG:  # by itself
            found = np.array(self._encode_long(words[order[at]])[::-1], np.int64)
            made.append((np.full(len(found), order[at]), np.arange(len(found)), found))
            counts[order[at]] = len(found)
            at += 1
        while at < len(order):
            longest = max(1, len(words[order[at]]))
            some = order[at : at + max(1, CELLS // longest)]
            at += len(some)
            made.append(self._encode_block(np.array(some), [words[k] for k in some], longest))
            np.add.at(counts, made[-1][0], 1)
        if not made:
            return np.zeros(0, np.int64), counts
        who, step, label = (np.concatenate(x) for x in zip(*made, strict=True))
        return label[np.lexsort((-step, who))], counts

    def _encode_long(self, word: bytes) -> list[int]:
        """One word, byte by byte."""
        following, _, _, _, last, _ = self._scalars()
        after, follow = [-1] * (len(word) + 1), following.get
        for i in range(1, len(word) + 1):
            node, j = 0, i
            while j > 0 and (node := follow(node * 256 + word[j - 1], 0)):
                j -= 1
                if last[node] >= 0 and (j == 0 or self.follows(after[j], last[node])):
                    after[i] = last[node]
                    break
            if after[i] < 0:
                raise ValueError(f"byte {word[i - 1]} is not in the vocabulary")
        out, i = [], len(word)
        while i:
            out.append(after[i])
            i -= len(self.labels[after[i]])
        return out[::-1]

    def _encode_block(self, names: np.ndarray, words: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, step from its end, label) of words in order of falling length."""
        length = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(len(words), longest).astype(np.int64)
        after = np.full((len(words), longest + 1), -1, np.int64)  # the label that ends at each byte: the state there
        falling = -length
        for i in range(1, longest + 1):
            alive = np.arange(np.searchsorted(falling, -i, side="right"))  # the words of i bytes or more
            node = np.zeros(len(alive), np.int64)
            for j in range(i - 1, -1, -1):
                key = node * 256 + text[alive, j]
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                there = self.keys[k] == key
                alive, node = alive[there], self.nodes[k[there]].astype(np.int64)
                if not len(alive):
                    break
                label = self.last[node]
                good = label >= 0
                if j:
                    spot = np.flatnonzero(good)
                    good[spot] = self._all_follow(after[alive[spot], j], label[spot])
                if good.any():
                    after[alive[good], i] = label[good]
                    alive, node = alive[~good], node[~good]
                    if not len(alive):
                        break
            if (hole := np.flatnonzero(after[: np.searchsorted(falling, -i, side="right"), i] < 0)).size:
                raise ValueError(f"byte {text[hole[0], i - 1]} is not in the vocabulary")
        out, left, step = [], length.copy(), 0
        rows = np.flatnonzero(left > 0)
        while len(rows):
            label = after[rows, left[rows]]
            out.append((names[rows], np.full(len(rows), step), label))
            left[rows] -= self.size[label]
            rows, step = rows[left[rows] > 0], step + 1
        if not out:
            return names[:0], names[:0], names[:0]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _all_follow(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """`follows` for many at once."""
        row, at = self.places[0, u].astype(np.int64), self.places[1, v]
        k = np.searchsorted(self.runs, (row << 32) + at, side="right") - 1
        inside = (k >= 0) & (self.runs[k] >> 32 == row)
        return ~(inside & (self.run_ends[k] > at))


class Automaton:
    """labels: the bytes of each token id; merges: (a, b, ab) as ids, in order of their rank."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels, self.cut = labels, {}
        self.left: dict[int, tuple[int, int]] = {}
        self.right: dict[int, tuple[int, int]] = {}
        for rank, (a, b, ab) in enumerate(merges):
            made = all(x in self.left or len(labels[x]) == 1 for x in (a, b))
            if ab not in self.left and made and self.arc(a, b):  # a merge that can never happen has no gadget
                self.cut[a, b] = rank
                self.left[ab], self.right[ab] = (a, rank), (b, rank)
        used = {i for i, s in labels.items() if len(s) == 1 or i in self.left}
        self._compile(sorted(used))
    def _compile(self, used: list[int]) -> None:
        """The table: for the state at place k of the right tree, starts[first[k]:first[k + 1]] and ends: the runs of places in the left tree that it has no arc to."""
        self.left_place, left_end = self._walk(self.left, used)
        self.right_place, right_end = self._walk(self.right, used)
        rows, tops, los, his = [], [], [], []
        for (x, p), rank in self.cut.items():
            rows.append(self.right_place[x])
            tops.append(right_end(x, rank + 1))
            los.append(self.left_place[p])
            his.append(left_end(p, rank))
        low, top = np.array(rows, np.int64), np.array(tops, np.int64)
        height = top - low
        which = np.repeat(np.arange(len(low)), height)
        row = np.arange(len(which)) - np.repeat(np.cumsum(height) - height, height) + low[which]
        lo, hi = np.array(los, np.int64)[which], np.array(his, np.int64)[which]
        order = np.lexsort((lo, row))
        row, lo, hi = row[order], lo[order], hi[order]
        far = np.maximum.accumulate((row << 32) + hi) - (row << 32) if len(row) else hi  # runs may lie within each other
        places = np.full((2, max(self.labels) + 1), -1, np.int32)
        for k, of in enumerate((self.right_place, self.left_place)):
            places[k, list(of)] = list(of.values())
        self.table = Table((row << 32) + lo, far.astype(np.int32), places, *self._trie(used), self.labels)

    def _trie(self, used: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The labels from behind, as a trie: sorted keys (node * 256 + byte), the nodes they lead to, and the label that ends at each node, or -1."""
        following, last = {}, [-1]
        for i in used:
            node = 0
            for byte in reversed(self.labels[i]):
                key = node * 256 + byte
                if key not in following:
                    following[key] = len(last)
                    last.append(-1)
                node = following[key]
            if last[node] < 0:
                last[node] = i
        keys = sorted(following)
        return np.array(keys, np.int64), np.array([following[k] for k in keys], np.int32), np.array(last, np.int32)

    @staticmethod
    def _walk(parents: dict[int, tuple[int, int]], used: list[int]) -> tuple[dict[int, int], Callable[[int, int], int]]:
        """Each label's place in a walk through the tree of its parents, latest child first; a function of (label, rank): one past the last place of the label and its children made at this rank or later."""
        children: dict[int, list[tuple[int, int]]] = {}
        for child, (parent, rank) in parents.items():
            children.setdefault(parent, []).append((rank, child))
        for c in children.values():
            c.sort(reverse=True)
        place, end, todo = {}, {}, [(i, False) for i in reversed(used) if i not in parents]
        while todo:
            i, done = todo.pop()
            if done:
                end[i] = len(place)
                continue
            place[i] = len(place)
            todo.append((i, True))
            todo += [(c, False) for _, c in reversed(children.get(i, []))]

        def past(label: int, rank: int) -> int:
            of = children.get(label, [])
            k = bisect_right(of, -rank, key=lambda c: -c[0])
            return end[of[k - 1][1]] if k else place[label] + 1

        return place, past

    def arc(self, u: int, v: int) -> bool:
        """Whether label v may follow label u, by what was cut so far."""
        x, x_until = u, NEVER
        while True:
            p, p_until = v, NEVER
            while True:
                at = self.cut.get((x, p), NEVER)
                if at != NEVER and at < x_until and at <= p_until:
                    return False
                if p not in self.left:
                    break
                p, p_until = self.left[p]
            if x not in self.right:
                return True
            x, x_until = self.right[x]


def read_vocabulary(path: str) -> Automaton:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, back = model["vocab"], printable_bytes()
    labels = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])


class Encoder(dict):
    """Words to their numbers; ids[start[k] : start[k + 1]] are the tokens of word k once `settle` was called."""

    def __init__(self, table: Table):
        super().__init__()
        self.table = table
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[bytes] = []
        self.ids, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.fresh.append(word.encode())
        return k

    def settle(self) -> None:
        ids, counts = self.table.encode_all(self.fresh)
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
        self.fresh = []

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words in a row, and how many each word has."""
        if len(self) > MOST_WORDS:
            self.forget()
        at = np.array([self[w] for w in words], np.int64)
        self.settle()
        count = self.start[at + 1] - self.start[at]
        return self.ids[np.repeat(self.start[at] - np.cumsum(count) + count, count) + np.arange(count.sum())], count


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(read_vocabulary(path).table)


KEPT: list[Encoder] = []  # a worker's


def shipped(shared: Broadcast, digest: int) -> Encoder:
    """The worker's encoder for the table that was broadcast, which is loaded only if the worker has another or none; the words that it knows stay from task to task."""
    if not KEPT or KEPT[0].table.digest != digest:
        KEPT.clear()
        KEPT.append(Encoder(shared.value))
    return KEPT[0]


def encode_text(text: str, path: str = VOCABULARY) -> list[int]:
    return encoder(path).tokens(SPLIT.findall(text))[0].tolist()


def decode(ids, path: str = VOCABULARY) -> bytes:
    labels = encoder(path).table.labels
    return b"".join([labels[i] for i in ids])


def encode_batches(batches: Iterator[pa.RecordBatch], e: Encoder) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ..) to ENCODED and the other columns."""
    labels, size = e.table.labels, e.table.size
    for whole in batches:
        for batch in pieces(whole, 2 << 20):
            texts = batch.column(1).to_pylist()
            split = [SPLIT.findall(t) for t in texts]
            ids, lengths = e.tokens(list(chain.from_iterable(split)))
            by_doc = np.cumsum([0, *(len(s) for s in split)])
            ends = np.concatenate([[0], np.cumsum(lengths)])[by_doc]
            raw = [t.encode() for t in texts]
            back = b"".join(map(labels.__getitem__, ids.tolist()))
            cut = np.concatenate([[0], np.cumsum(size[ids])])[ends]
            same = [back[a:b] == r for a, b, r in zip(cut[:-1].tolist(), cut[1:].tolist(), raw, strict=True)]
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(np.diff(ends)), tokens, pa.array(same), *batch.columns[2:]], names=[*ENCODED.names, *batch.schema.names[2:]])


def bpe_encoded(docs: DataFrame, path: str = VOCABULARY, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, token_ids, round_trip, *also): round_trip says that decoding gives the text's bytes again."""
    narrow = picked(docs, "doc_id", "text", *also)
    texts = narrow.select(*keyed_columns(), *also)
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[2:])
    table = encoder(path).table
    shared, digest = docs.sparkSession.sparkContext.broadcast(table), table.digest
    return texts.mapInArrow(lambda b: encode_batches(b, shipped(shared, digest)), f"doc_id long, n_bytes long, n_tokens long, token_ids array<int>, round_trip boolean{more}")


def keyed_columns() -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]


def decoded(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids)."""

    table = encoder(path).table
    shared, digest = encoded.sparkSession.sparkContext.broadcast(table), table.digest

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = shipped(shared, digest).table.labels
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join([labels[i] for i in x or []]).decode("utf-8", "replace") for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return picked(encoded, "doc_id", "token_ids").mapInArrow(back, "doc_id long, text string")
