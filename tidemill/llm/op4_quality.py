"""Operator 4, quality classifier: nearest-neighbour voting in a latent-semantic space.

Fit: at most `SAMPLE` labelled documents, the first by a hash of doc_id in each pair of labels, so that all pairs have a share; the
bound is the parameter `sample`. Their term counts go to the driver (hashes and counts, never texts), where the `FEATURES` terms that
tell most about the labels are weighted by how much they tell and the matrix is reduced to `DIMS` latent dimensions. Score: the term
weights and the labelled vectors, both of bounded size, are broadcast; every document is projected, its cosines with all labelled
vectors are computed exactly in blocks, and those not under the `NEIGHBOURS`-th largest vote, weighted by cosine. A document is kept
when its quality vote is at least one half and its toxic vote is under it.

Terms: lower-case words, the first STEM letters of longer words, runs of punctuation, one for words in capitals and one for words that
repeat the word before them. As each pair of labels has the same share of the sample, votes are weighted back to the shares of all
labelled documents.

Defined results: a text with no known term (null or empty ones too) has null scores and is kept; without labelled documents
everything is; labels that are null are no labels; of several labels of one document any one with the least values counts; a null
doc_id is scored but never labelled; very long texts count with all their terms; repeated rows are scored each; ties at the last neighbour all
vote; of terms that tell as much the lesser hash is a feature first; an empty table gives an empty result; extra columns are ignored here and
kept by the pipeline's stage, also those whose names differ from a needed one's in case alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, keyed_texts, picked, pieces, with_row

SAMPLE, FEATURES, DIMS, NEIGHBOURS = 4096, 1024, 96, 5
STEM = 4
term_pattern = re.compile(r"\w+|[^\w\s]+")
UPPER, AGAIN = "\0upper", "\0again"


def terms(text: str) -> Counter:
    found = term_pattern.findall(text)
    low = text.lower()
    count = Counter(term_pattern.findall(low) if len(low) != len(text) else [t.lower() for t in found])
    if upper := sum(map(str.isupper, found)):
        count[UPPER] = upper
    again = sum(map(eq, found, found[1:]))
    stems: dict[str, int] = {}
    for word, n in count.items():
        if len(word) > STEM:
            stem = "\1" + word[:STEM]
            stems[stem] = stems.get(stem, 0) + n
    count.update(stems)
    if again:
        count[AGAIN] = again
    return count


def hashed_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    count = terms(text)
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in count), np.uint64, len(count)), np.fromiter(count.values(), np.int64, len(count))


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [hashed_terms(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array([h.tobytes() for h, _ in pairs], pa.binary()), pa.array([n.tobytes() for _, n in pairs], pa.binary())], names=["quality", "toxic", "terms", "counts"])


def known_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality, toxic) of the labelled documents."""
    known = picked(labels, "doc_id", "quality", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("x")).select("doc_id", "x.*")
    return known.join(docs.select("doc_id").filter("doc_id is not null"), "doc_id", "left_semi")


def labelled_sample(known: DataFrame, sample: int) -> DataFrame:
    """At most `sample` rows of known."""
    rank = F.row_number().over(Window.partitionBy("quality", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return known.withColumn("r", rank).orderBy("r", "quality", "toxic").limit(sample).drop("r")


class Space:
    """The latent space: sorted term hashes, their vectors, and the labelled vectors with their two labels."""

    def __init__(self, quality: np.ndarray, toxic: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], features: int, dims: int, shares: dict[tuple[int, int], float] | None = None):
        n = len(rows)
        drawn = Counter(zip(quality.tolist(), toxic.tolist(), strict=True))
        stands_for = np.array([(shares or drawn)[x] / drawn[x] for x in zip(quality.tolist(), toxic.tolist(), strict=True)])
        labels = np.stack([quality, toxic], 1).astype(np.float64)
        every = np.concatenate([h for h, _ in rows])
        owner = np.repeat(np.arange(n), [len(h) for h, _ in rows])
        names, column = np.unique(every, return_inverse=True)
        df = np.bincount(column, minlength=len(names)).astype(float)
        told = np.zeros(len(names))
        for y in labels.T:
            yes = np.bincount(column, weights=y[owner], minlength=len(names))
            p1, p0 = (yes + 0.5) / (y.sum() + 1), (df - yes + 0.5) / (n - y.sum() + 1)
            odds = np.abs(np.log(p1 / (1 - p1)) - np.log(p0 / (1 - p0)))
            told = np.maximum(told, odds * np.abs(p1 - p0) / np.sqrt(np.maximum(p1 * (1 - p1) + p0 * (1 - p0), 1e-3)))
        told[df < min(3, n)] = 0
        best = np.sort(np.argsort(-told, kind="stable")[:features])
        best = best[told[best] > 0] if (told[best] > 0).any() else best
        self.names, self.weight = names[best], np.sqrt(told[best]) + 1e-6
        slot = np.full(len(names), -1)
        slot[best] = np.arange(len(best))
        x = np.zeros((n, len(best)))
        some = slot[column] >= 0
        tf = np.log1p(np.concatenate([c for _, c in rows]))
        x[owner[some], slot[column[some]]] = tf[some] * self.weight[slot[column[some]]]
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        values, vectors = np.linalg.eigh(x.T @ x)
        top = vectors[:, np.argsort(-values)[:dims]]
        self.terms = (top * self.weight[:, None]).astype(np.float32)
        points = (x @ top).astype(np.float32)
        size = np.linalg.norm(points, axis=1)
        good = size > 1e-6
        self.points = (points[good] / size[good, None]).astype(np.float32)
        self.labels = labels[good].astype(np.float32)
        self.stands_for = (stands_for[good] / stands_for.max()).astype(np.float32)

    def projected(self, owner: np.ndarray, names: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """Unit vectors of n documents; zeros where no term is known."""
        out = np.zeros((n, self.terms.shape[1]), np.float32)
        if len(self.names) and len(names):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            hit = self.names[at] == names
            owner, part = owner[hit], self.terms[at[hit]] * np.log1p(counts[hit])[:, None].astype(np.float32)
            if len(owner):
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                out[owner[first]] = np.add.reduceat(part, first, axis=0)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-6)

    def votes(self, vectors: np.ndarray, neighbours: int) -> np.ndarray:
        """(quality, toxic) votes; NaN where there are none."""
        out = np.full((len(vectors), 2), np.nan)
        k = min(neighbours, len(self.points))
        for at in range(0, len(vectors) if k else 0, 512):
            cos = vectors[at : at + 512] @ self.points.T
            last = np.partition(cos, cos.shape[1] - k, axis=1)[:, [cos.shape[1] - k]]
            weight = np.where(cos >= last, np.maximum(cos, 0) * self.stands_for, 0)
            total = weight.sum(1, keepdims=True)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[at : at + 512] = np.where(total > 0, (weight @ self.labels) / total, np.nan)
        return out


def quality_votes(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, dims: int = DIMS, neighbours: int = NEIGHBOURS):
    """A function of batches (doc_id, text, ..) that yields them with quality_score, toxic_score and keep appended."""
    texts = keyed_texts(docs)
    known = cut_lineage(known_labels(texts, labels))
    shares = {(r[0], r[1]): r[2] for r in known.groupBy("quality", "toxic").count().collect()}
    chosen = F.broadcast(labelled_sample(known, sample))  # never over `sample` rows
    rows = texts.join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "quality", "toxic").mapInArrow(_sample_terms, "quality int, toxic int, terms binary, counts binary").collect()
    rows.sort(key=lambda r: (r["quality"], r["toxic"], bytes(r["terms"])))
    space = Space(np.array([r["quality"] for r in rows]), np.array([r["toxic"] for r in rows]), [(np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], np.int64)) for r in rows], features, dims, shares) if rows else None
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                n = batch.num_rows
                votes = np.full((n, 2), np.nan)
                if shared.value is not None:
                    pairs = [hashed_terms(t) for t in batch.column(1).to_pylist()]
                    owner = np.repeat(np.arange(n), [len(h) for h, _ in pairs])
                    votes = shared.value.votes(shared.value.projected(owner, np.concatenate([h for h, _ in pairs]), np.concatenate([c for _, c in pairs]), n), neighbours)
                none = np.isnan(votes[:, 0])
                keep = none | ((votes[:, 0] >= 0.5) & (votes[:, 1] < 0.5))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(votes[:, 0], mask=none), pa.array(votes[:, 1], mask=none), pa.array(keep)], names=[*batch.schema.names, "quality_score", "toxic_score", "keep"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """(doc_id, quality_score, toxic_score, keep) for every row."""
    score = quality_votes(docs, labels, **parameters)
    return keyed_texts(docs).mapInArrow(score, "doc_id long, text string, quality_score double, toxic_score double, keep boolean").drop("text")


def kept_documents(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that are kept, with all their columns; none of them is shuffled."""
    score = quality_votes(docs, labels, **parameters)
    wide, again = with_row(docs, "doc_id", "text")
    wide = wide.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "row")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in score(batches):
            yield pa.RecordBatch.from_arrays([b.column(2).filter(b.column(5))], names=["row"])

    return again(wide.mapInArrow(kept, f"row {wide.schema['row'].dataType.simpleString()}"))
