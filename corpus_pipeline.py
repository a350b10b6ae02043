"""A training corpus from raw documents: each stage is one operator, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webtally.llm import stages
from webtally.llm.common import written

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.keep_one_of_each_group),
    ("decontamination", stages.remove_benchmark_passages),
    ("pii", stages.replace_personal_data),
    ("bpe", stages.encode),
]

#: Learned scores, fingerprints of shingles and byte-pair merges have no SQL form; tests compare with plain programs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
