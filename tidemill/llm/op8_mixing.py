"""Operator 8, mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies. Among all rates that give each source its target share of the tokens
and leave the languages their shares, those closest to 1 in token-weighted relative entropy are exp(lambda_source + mu_language). The
dual is convex; lambda has a closed form given mu, which leaves a dual over the languages:

    f(mu) = sum_s t_s log(sum_l n_sl exp(mu_l)) - u . mu + RIDGE / 2 * T |mu|^2

with n the tokens by source and language, t and u the targets. Newton's method minimises it: each iteration sums gradient and Hessian
over the sources on the executors, the driver solves a system as large as the number of languages and halves the step while f does not
fall. The ridge makes the solution unique and finite where a language's share cannot be met; sources' shares are met exactly. A rate
becomes copies by its whole part and, with the chance of its fraction, one more; the chance is drawn from MD5 of the seed and doc_id.

Targets: weights by source where given (a source that is not named gets none), else tokens ** POWER; both are scaled to 1. The sum
of tokens after mixing is `budget` tokens, by default that of the corpus.

Defined results: null sources and languages are groups of their own; null and empty texts have 0 tokens, weigh nothing and get their
cell's rate, 1 if no text of their source and language has a token; very long texts count with all their tokens, so one may be most of a
cell; a null doc_id draws as -1; repeated rows are mixed each and draw alike; an empty table gives an empty result; extra columns are
ignored here and kept by the pipeline's stage, also those whose names differ from a needed one's in case alone. Rates that Newton's steps don't reach are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, picked, with_row

#: Rates are broadcast up to so many rows (sources times languages); beyond, the join shuffles.
BROADCAST_ROWS = 200_000
POWER, RIDGE, TOLERANCE, SEED = 0.5, 1e-4, 1e-10, "mix-1"


def token_count(text):
    return F.expr(f"regexp_count({text}, '[^ \\\\t\\\\n\\\\r\\\\f]+')")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, n_tokens) for every row."""
    narrow = picked(docs, "doc_id", "source", "lang", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return narrow.select("doc_id", "source", "lang", token_count("text").cast("long").alias("n_tokens"))


def dual(mu: np.ndarray, target: np.ndarray, tokens: np.ndarray, hessian: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """The sources' part of f, its gradient and its Hessian; tokens has a row for each source, target its t."""
    z = np.where(tokens > 0, np.log(np.maximum(tokens, 1e-300)), -np.inf) + mu
    top = z.max(1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(1, keepdims=True)
    p = e / total
    f = float((target * (top + np.log(total))[:, 0]).sum())
    grad = target @ p
    return f, grad, (np.diag(grad) - (p * target[:, None]).T @ p) if hessian else np.zeros((0, 0))


def balanced(by_source: DataFrame, languages: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """mu for rows (target, tokens: an array over the languages) and the languages' targets; both sum to T."""
    size, total = len(languages), float(languages.sum())

    def at(mu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros(1 + size + size * size)
            for b in batches:
                if b.num_rows:
                    f, g, h = dual(mu, b.column(0).to_numpy(), np.stack(b.column(1).to_numpy(zero_copy_only=False)))
                    acc += np.concatenate([[f], g, h.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], pa.binary())], names=["part"])

        acc = np.sum([np.frombuffer(r[0]) for r in by_source.mapInArrow(part, "part binary").toLocalIterator()], axis=0)
        g, h = acc[1 : 1 + size], acc[1 + size :].reshape(size, size)
        return acc[0] - languages @ mu + ridge / 2 * total * mu @ mu, g - languages + ridge * total * mu, h + ridge * total * np.eye(size)

    mu = np.zeros(size)
    f, g, h = at(mu)
    for _ in range(100):
        step = np.linalg.solve(h, -g)
        if np.abs(g).max() <= TOLERANCE * total:
            break
        scale = 1.0
        while scale > 1e-8:
            new = at(mu + scale * step)
            if new[0] <= f + 1e-4 * scale * (g @ step) + 1e-12 * abs(f):
                break
            scale /= 2
        mu = mu + scale * step
        f, g, h = new
    else:
        raise ArithmeticError(f"no solution in 100 steps: {np.abs(g).max() / total:g} of the tokens are off")
    return mu


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, budget: float | None = None, ridge: float = RIDGE) -> DataFrame:
    """(source, lang, rate): one row for each source and each language that occur, however small; empty for a corpus without tokens."""
    cells = cut_lineage(measured(docs).groupBy("source", "lang").agg(F.sum("n_tokens").alias("n")).filter("n > 0"))
    spark = docs.sparkSession
    names = [r[0] for r in cells.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()]
    of_lang = {r[0]: float(r[1]) for r in cells.groupBy("lang").agg(F.sum("n")).collect()}
    vector = F.array(*(F.coalesce(F.sum(F.when(F.col("lang").eqNullSafe(F.lit(x)), F.col("n"))), F.lit(0)).cast("double") for x in names)) if names else F.array(F.lit(0.0))
    wide = cells.groupBy("source").agg(F.sum("n").alias("n"), vector.alias("tokens"))
    if weights is None:
        wide = wide.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0], "named string, weight double")
        wide = wide.join(given, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    wide = cut_lineage(wide)
    whole = wide.agg(F.sum("weight"), F.sum("n")).first()
    total = float(budget or sum(of_lang.values()))
    if not whole[0]:
        return spark.createDataFrame([], "source string, lang string, rate double")
    wide = wide.withColumn("target", F.col("weight") / F.lit(float(whole[0])) * F.lit(total))
    reach = np.array([of_lang[x] for x in names])
    mu = balanced(wide.select("target", "tokens"), reach / reach.sum() * total, ridge)
    tilt = F.array(*(F.lit(float(np.exp(m))) for m in mu))
    mass = F.aggregate(F.zip_with("tokens", tilt, lambda n, e: n * e), F.lit(0.0), lambda a, x: a + x)
    each = wide.select("source", (F.col("target") / mass).alias("base"), F.posexplode(tilt).alias("k", "e"))
    back = spark.createDataFrame([(k, x) for k, x in enumerate(names)], "k int, lang string")
    found = each.join(back, "k").select("source", "lang", (F.col("base") * F.col("e")).alias("rate"))
    if weights is not None:
        found = cells.select("source").distinct().join(wide.select(F.col("source").alias("has")), F.col("source").eqNullSafe(F.col("has")), "left_anti").crossJoin(back).select("source", "lang", F.lit(0.0).alias("rate")).unionByName(found)
    return cut_lineage(found)


def drawn(doc_id, seed: str = SEED):
    """A number in [0, 1) from the seed and doc_id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id, F.lit(-1)).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_copies(rows: DataFrame, found: DataFrame, seed: str = SEED) -> DataFrame:
    """rows (with row.doc_id, row.source and row.lang) with rate and copies; the table of rates is broadcast when it has no more than BROADCAST_ROWS rows."""
    there = found.select(F.col("source").alias("rate_source"), F.col("lang").alias("rate_lang"), F.col("rate").alias("cell_rate"))
    if found.count() <= BROADCAST_ROWS:
        there = F.broadcast(there)
    rate = F.coalesce(F.col("cell_rate"), F.lit(1.0))
    joined = rows.join(there, F.col("row.source").cast("string").eqNullSafe(F.col("rate_source")) & F.col("row.lang").cast("string").eqNullSafe(F.col("rate_lang")), "left")
    whole = joined.withColumn("rate", rate)
    up = (drawn(F.col("row.doc_id").cast("long"), seed) < F.col("rate") - F.floor("rate")).cast("int")
    return whole.withColumn("copies", (F.floor("rate") + up).cast("int")).select("row", "rate", "copies")


def mixture(docs: DataFrame, seed: str = SEED, **parameters) -> DataFrame:
    """(doc_id, source, lang, n_tokens, rate, copies) for every row."""
    rows = measured(docs).select(F.struct("doc_id", "source", "lang", "n_tokens").alias("row"))
    return with_copies(rows, rates(docs, **parameters), seed).select("row.*", "rate", "copies")


def mixed_documents(docs: DataFrame, seed: str = SEED, **parameters) -> DataFrame:
    """The rows of docs, with all their columns, as often as their copies say."""
    wide, again = with_row(docs, "doc_id", "source", "lang")
    rows = wide.select(F.struct("doc_id", "source", "lang", "row").alias("row"))
    out = with_copies(rows, rates(docs, **parameters), seed).filter("copies > 0")
    return again(out.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.row"))
