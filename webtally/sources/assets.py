"""Readers for tables of collected files, requests and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..catalog.paths import BINARY_CONTENT_TYPES
from ..functions import urls
from ..schema import ASSETS, REQUESTS, struct_type

SPREAD_LIMIT = 1 << 30


def spread_small(df: DataFrame, limit: int = SPREAD_LIMIT) -> DataFrame:
    """Spread a small table that sits in fewer pieces than there are cores.

    Text analysis is bound by CPU; one small file with one row group would keep a
    single core busy. Tables above ``limit`` bytes are read as they are stored:
    they have splits enough, and moving their text would cost more than it gains.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= limit and len(df.inputFiles()) < cores else df


def load_assets(spark: SparkSession, path: str) -> DataFrame:
    """Collected files: one row per file, parquet."""
    return spread_small(spark.read.schema(ASSETS).parquet(path))


def pages_as_assets(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").alias("asset_id"), "url", F.lit("html").alias("file_type"), F.col("html").alias("content"),
        F.length("html").alias("size"),
    )


def documents_as_assets(documents: DataFrame, *keep: str | Column) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("asset_id"), F.concat(F.lit("doc://"), "doc_id").alias("url"),
        F.lit("txt").alias("file_type"), F.col("text").alias("content"), F.length("text").alias("size"), *keep,
    )


def admit_assets(fetched: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Successful responses of textual type, and of bounded size if a bound is given, become assets."""
    binary = F.lit(False)
    for kind in BINARY_CONTENT_TYPES:
        binary = binary | F.contains("content_type", F.lit(kind))
    kept = fetched.where((F.col("status") == 200) & ~F.coalesce(binary, F.lit(False)) & F.col("content").isNotNull())
    if max_bytes is not None:
        kept = kept.where(F.octet_length("content") <= max_bytes)
    return kept.select(
        "asset_id", "url", urls.file_type(F.col("url")).alias("file_type"), "content", F.length("content").alias("size")
    )


def file_type(url: Column) -> Column:
    return urls.file_type(url)


def load_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Captured network log with an explicit schema."""
    return spark.read.schema(REQUESTS).format(fmt).load(path)


def stream_source(
    spark: SparkSession, path: str, ddl: str, files_per_trigger: int = 64, file_glob: str = "*.parquet"
) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(struct_type(ddl))
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", file_glob)
        .parquet(path)
    )
