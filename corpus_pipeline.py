"""A corpus pipeline of five stages over ``documents``: toxic documents go, one document of each group of near duplicates
stays, passages that repeat are cut out, sources are mixed to their targets, and what is left is tokenized.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's result to the shared folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltaloom.llm import bpe, common, mixing, ngram_join, repeats, toxicity
from deltaloom.llm.queries import vocabulary


PASSAGES = {"length": 240, "words": 51}


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.3, by a model of the labels of all rows but the held-out ones."""
    common.ship(spark)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard 0.8 or more connect, that with the least doc_id."""
    common.ship(spark)
    return ngram_join.one_of_each(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words that occur twice: runs of bytes that strings of 240 bytes cover which do, if
    they have 51 words or more; n_chars is set anew. In 51 words are 240 bytes or more, but for about one run in twenty."""
    common.ship(spark)
    return repeats.without_repeats(docs, **PASSAGES)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources (weights 5, 2, 1, at most three times each) takes it."""
    common.ship(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, decoded_sha256 of each row."""
    common.ship(spark)
    return bpe.tokenized(docs, vocabulary())


STAGES = [("toxicity", not_toxic), ("n-gram join", one_of_each_group), ("repeats", no_repeats), ("mixing", mixed_sources), ("bpe", tokens)]
#: Hashing, segment scans and BPE have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), spark)
    return docs
