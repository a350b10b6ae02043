"""Shards of near equal size by sampled splitters (operator 7, DataFrame functions only).

Rows are ordered by (hash of the text, id, place in a written table): equal texts lie together, everything else is spread evenly. A sample in which
a row's chance grows with its size gives the quantile boundaries of many ranges, some for each shard. The ranges are then
measured over all rows; those over their size are divided again by a sample of their own. Consecutive ranges are dealt to
the shards by their cumulative size. A boundary falls between texts, unless one text alone fills more than a range: then
it falls between its copies, by id and, where ids repeat too, by place, so that no shard and no task gets all of them.

A null text has no bytes and the hash of null; null ids come first. Repeated rows are rows of their own, with slots of
their own. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import constant
from .common import NO_ID, document_rows, text_bytes, utf8, written

#: Bytes every row counts for besides its text.
ROW_BYTES = 16
#: Ranges for each shard, sampled rows for each range, and the factor over the mean at which a range is divided again.
RANGES_PER_SHARD, SAMPLES_PER_RANGE, OVERFULL = 64, 24, 2.0
#: Rounds of dividing; more are needed only where sizes inside a range are very uneven.
ROUNDS = 3

Splitter = tuple[int, int, int]


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What sharding needs of each row: no text."""
    text = F.col("text")
    return document_rows(docs, id_col, text_col).select(
        "doc_id", (text_bytes(text) + ROW_BYTES).alias("size"), F.crc32(utf8(text)).alias("text_crc32"),
        F.xxhash64("text").alias("k"), F.coalesce("doc_id", F.lit(NO_ID)).alias("i"),
        F.monotonically_increasing_id().alias("r"),
    )


def _sampled(rows: DataFrame, step: float, seed: int) -> DataFrame:
    """Each row as often as its size makes it cross a multiple of ``step``, from a start that its key and id decide."""
    start = F.pmod(F.xxhash64(F.lit(seed), "k", "i", "r"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.withColumn("n", F.floor(F.col("size") / F.lit(step) + start)).filter("n > 0").select("k", "i", "r", "n")


def _boundaries(sample: list[tuple[int, int, int, int]], ranges: int, open_at: Splitter | None = None) -> list[Splitter]:
    """Quantiles of a weighted sample. A boundary within one text moves to its start unless the text has several."""
    ordered = sorted(sample)
    total = sum(n for *_, n in ordered)
    found: list[Splitter] = []
    seen, target = 0, 1
    for k, i, r, n in ordered:
        seen += n
        while target < ranges and seen * ranges > total * target:
            found.append((k, i, r))
            target += 1
    found = sorted(set(found))
    out: list[Splitter] = []
    for k, i, r in found:
        start = (k, NO_ID, -1)
        alone = bisect_right(found, (k, 1 << 63, 0)) - bisect_right(found, start) == 1
        out += [start] if alone else [start, (k, i, r)]
    return sorted(set(out) - {open_at})


def _at_or_before(splitters: list[Splitter]) -> Column:
    """How many splitters are at or before a row: two looks at short arrays instead of one at a long one."""
    if not splitters:
        return F.lit(0)
    width = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[a : a + width] for a in range(0, len(splitters), width)]
    triple = lambda s: dict(zip("kir", s))
    row = F.struct("k", "i", "r")
    heads = constant([triple(b[0]) for b in blocks], "array<struct<k:bigint,i:bigint,r:bigint>>")
    inner = constant([[triple(s) for s in b] for b in blocks], "array<array<struct<k:bigint,i:bigint,r:bigint>>>")
    upto = lambda array: F.size(F.filter(array, lambda s: s <= row))
    block = upto(heads)
    return F.when(block == 0, 0).otherwise((block - 1) * width + upto(F.get(inner, block - 1)))


def _in_range(rows: DataFrame, splitters: list[Splitter]) -> DataFrame:
    return rows.withColumn("range", _at_or_before(splitters).cast("int"))


def split_points(rows: DataFrame, shards: int) -> tuple[list[Splitter], list[tuple[int, int, int]]]:
    """Splitters, and (range, bytes, rows) of the ranges between them."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = shards * RANGES_PER_SHARD
    if not total:
        return [], []
    step = total / (ranges * SAMPLES_PER_RANGE)
    # at most total / step + 1 draws: their number does not grow with the data
    sample = [tuple(r) for r in _sampled(rows, step, 0).select("k", "i", "r", F.col("n").cast("bigint")).collect()]
    splitters = _boundaries(sample, ranges)
    full = OVERFULL * total / ranges
    for round_ in range(ROUNDS + 1):
        sized = _in_range(rows, splitters).groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        measured = sorted(tuple(r) for r in sized.select("range", "size", "n").collect())
        over = {r: size for r, size, n in measured if size > full and n > 1}
        if not over or round_ == ROUNDS:
            return splitters, measured
        inside = _in_range(rows, splitters).filter(F.col("range").isin(list(over)))
        drawn = _sampled(inside.drop("range"), step / 4, round_ + 1)
        by_range: dict[int, list] = {}
        for k, i, r, n in drawn.select("k", "i", "r", F.col("n").cast("bigint")).collect():
            by_range.setdefault(bisect_right(splitters, (k, i, r)), []).append((k, i, r, n))
        more = set(splitters)
        for r, size in over.items():
            more.update(_boundaries(by_range.get(r, []), max(2, round(2 * size * ranges / total))))
        if len(more) == len(splitters):
            return splitters, measured
        splitters = sorted(more)


def _dealt(measured: list[tuple[int, int, int]], shards: int) -> tuple[dict[int, int], dict[int, int]]:
    """The shard of each range, by where the middle of its bytes lies, and its first slot there."""
    total = sum(size for _, size, _ in measured)
    shard_of, slot_of, before, used = {}, {}, 0, [0] * shards
    for r, size, n in measured:
        shard = min(shards - 1, int((before + size / 2) * shards // total))
        shard_of[r], slot_of[r] = shard, used[shard]
        used[shard] += n
        before += size
    return shard_of, slot_of


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; sizes of the shards are near equal."""
    rows = written(described(docs, id_col, text_col), "shard-rows")
    splitters, measured = split_points(rows, shards)
    shard_of, slot_of = _dealt(measured, shards)
    last = max(shard_of, default=0) + 1
    lookup = lambda of: F.get(constant([of.get(r, 0) for r in range(last)], "array<bigint>"), F.col("range"))
    within = Window.partitionBy("range").orderBy("k", "i", "r")
    placed = _in_range(rows, splitters).withColumn("place", F.row_number().over(within) - 1)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), lookup(shard_of).cast("int").alias("shard"),
        (lookup(slot_of) + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
