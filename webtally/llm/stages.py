"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and applies one operator to all rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe_codec, decontaminate, pii, simhash, toxicity


def _with_length(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``n_chars`` of the new text, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: rows that score as toxic go."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxic_filter(docs, lexicon, 0.3)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each group of near duplicates the smallest id stays (five words, similarity 0.8)."""
    return simhash.one_of_each_group(docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: passages of ten words or more that a benchmark item has are cut out."""
    return _with_length(decontaminate.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: personal data get surrogates."""
    name = max(docs.columns, key=len) + "_kinds"  # no column of the documents
    return _with_length(pii.with_surrogates(docs, "corpus key 1", kinds_col=name).drop(name), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: token counts and digests of ids and decoded text."""
    return bpe_codec.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))
