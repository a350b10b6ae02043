"""What the text operators share: row identity, written tables and Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder

#: Stands for a null id where rows must be matched by id.
NO_ID = -(2**63)


def document_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names, so that no other column can clash."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``document_rows`` with a row key (``k_id``, ``k_text``) that is never null.

    Rows that repeat in id and text have the same key and the same result.
    """
    rows = document_rows(docs, id_col, text_col)
    return rows.select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("k_id"), F.xxhash64("text").alias("k_text")
    )


def utf8(text: Column) -> Column:
    """The bytes of a text; none for null."""
    return F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("bigint"), F.lit(0).cast("bigint"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/webtally/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def discarded(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function that turns one batch into some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch) or ()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, empty for null."""
    return [t or "" for t in batch.column(name).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array; ``is_space`` says it of each byte value."""
    inside = ~is_space[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = change[inside[change]], change[~inside[change]]
    if inside[0]:
        starts = np.concatenate(([0], starts))
    if inside[-1]:
        ends = np.concatenate((ends, [len(inside)]))
    return starts.astype(np.int64), ends.astype(np.int64)


_RANDOM = np.random.default_rng(20260101)
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)


#: Bytes of words hashed at once, so that the numbers made of each byte stay small in memory.
HASHED = 1 << 18


def _sums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each word's byte values weighted by their place."""
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    values = _BYTE_VALUES[data[np.repeat(starts, lengths) + place]]
    return np.add.reduceat(values * _POWERS[place & 4095], first)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word; words must not be empty."""
    lengths = ends - starts
    upto = np.cumsum(lengths)
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HASHED, "right"))
        if b > a:
            out[a:b] = _sums(data, starts[a:b], lengths[a:b])
        else:  # one very long word, piece by piece
            b = a + 1
            for turn, at in enumerate(range(int(starts[a]), int(ends[a]), HASHED)):
                piece = np.array([min(HASHED, int(ends[a]) - at)])
                out[a] = mixed(out[a : a + 1] + np.uint64(turn))[0] + _sums(data, np.array([at]), piece)[0]
        a = b
    return mixed(out + lengths.astype(np.uint64))


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive values."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(seed * 2 + 1))
    for j in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mixed(total)


#: The byte values that end words in the contracts: space and 0x09 to 0x0D. (Fixed values.)
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
