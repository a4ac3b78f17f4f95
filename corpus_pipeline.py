"""The corpus pipeline: STAGES, each over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir), where docs has the columns of documents, and returns a DataFrame; all but the last return
these columns, extra ones included, whatever their names. No stage shuffles a text but the near-dedup where more documents go than can be broadcast.
Each stage's defined results for nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns are those of its
operator, with what its own docstring adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import cut_lineage, with_row
from tidemill.llm.op4_quality import kept_documents
from tidemill.llm.op7_bpe import bpe_encoded
from tidemill.llm.op8_mixing import mixed_documents
from tidemill.llm.op9_surrogates import checked, key_of, surrogate_documents
from tidemill.llm.op10_simhash import simhash_groups

BROADCAST_IDS = 1_000_000  # the ids that go are broadcast up to so many; beyond, the join shuffles


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. One without a vote (null or empty text, no known word, no labels at all) stays, and so does one
    without doc_id if its text has the votes; very long texts are judged whole; repeated rows are judged alike."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the least doc_id stays; rows of one doc_id stay or go together. Rows without doc_id and texts without a word
    (null and empty ones too) are nobody's copies and stay; very long texts are compared by all their words."""
    gone = cut_lineage(simhash_groups(docs).filter(~F.col("keep")).select(F.col("doc_id").alias("gone_id")))
    wide, again = with_row(docs, "doc_id")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return again(wide.join(few, F.col("doc_id").cast("long") == F.col("gone_id"), "left_anti"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced in the texts, n_chars counted again; every document stays, null texts stay null, empty ones empty,
    very long ones are searched whole, and rows that repeat are rewritten alike. Surrogates that weren't distinct would be an error."""
    key = key_of(spark)
    return surrogate_documents(checked(docs, key), key)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target weight gives it copies, which may be none. Null sources and languages are groups of their own;
    null and empty texts weigh nothing and take their group's rate; rows of one doc_id draw alike, rows without one as -1."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, token_ids, round_trip, lang, source) for every row; null and empty texts have no tokens, very long ones all of
    theirs, a null doc_id is kept."""
    return bpe_encoded(docs, also=("lang", "source"))


STAGES = [("quality classifier", quality_classifier), ("SimHash near-dedup", near_dedup), ("PII surrogates", surrogates), ("mixing to target weights", mixing), ("BPE encoding", encoding)]
ORACLE_SQL = None  # a trained classifier, fingerprints and a tokenizer are no SQL; tests/llm has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
