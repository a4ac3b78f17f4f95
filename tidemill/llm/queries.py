"""The operators as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op1_chunks import passages

    return passages(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op3_ctw import tree_scores

    return tree_scores(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op2_suffixes import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their votes; what it rejects is what isn't there."""
    from .op4_quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).filter("keep")


def op5_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op5_vptree import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_tiles import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op7_bpe import bpe_encoded

    return bpe_encoded(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op8_mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op9_surrogates import checked, key_of, surrogate_texts

    key = key_of(spark)
    return surrogate_texts(checked(table(spark, sf_dir, "documents"), key), key)


def queries() -> dict:
    """By number: a query's name starts with its operator's."""
    found = (op1_substring_dedup, op2_suffix_dedup, op3_lm_scoring, op4_quality_classifier, op5_vptree, op6_embedding_tiles, op7_bpe, op8_mixing, op9_surrogates, op10_simhash)
    return {f.__name__: f for f in found}


#: All pairs of vectors at the threshold, and what links lead to, one link at a time.
NEAR = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
g AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT p.b, g.root FROM g JOIN p ON p.a = g.node)
SELECT v.vec_id, min(v.vec_id) OVER (PARTITION BY v.embedding) AS class_id, coalesce(l.n, 0) AS n_links, r.root AS group_id
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) l ON l.a = v.vec_id JOIN (SELECT node, min(root) AS root FROM g GROUP BY node) r ON r.node = v.vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op6_embedding_tiles": NEAR}
