"""Repeated byte strings by a run-length index (operator 1).

Every window of ``width`` bytes belongs to one stretch of text: the windows in a row whose smallest inner string hash is
the same. That hash is the stretch's key; equal windows have equal keys, wherever they are. So the corpus splits by key
into groups that can be judged apart. Only keys with more than one stretch matter, or with a stretch that may repeat itself:

* stretches that are equal as a whole are counted, in each task first; all their windows are repeated;
* different stretches under one key meet in an index: the Burrows-Wheeler transform of a block of such groups, as runs,
  with suffix positions sampled at both ends of every run. Matching statistics against the rest of the block stream from
  the samples: between two samples they fall by one with each position. Statistics of ``width`` or more mark a window;
* a key with more different stretches than an index may hold is judged by fingerprints of its single windows, which are
  counted like any other rows: nothing is compared within one task, and nothing is left out.

Null and empty texts, and texts shorter than ``width``, keep all they have. Rows that repeat in id and text are repeats
of each other. Texts of any length are read in chunks. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import keyed_rows, mixed, shuffle_partitions, written

#: Length of the strings whose smallest hash keys a window: a power of two.
INNER = 32
#: Positions of a text handled at once.
CHUNK = 1 << 21
#: Bytes of an index block; groups are put together up to it.
BLOCK = 2 << 20
#: Different stretches of one key that still meet in an index.
LARGEST_GROUP = 4_000

_RNG = np.random.default_rng(400)
_BYTES = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_FACTORS = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def string_hashes(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of every string of ``length`` bytes, by doubling."""
    level, done, out, x = 0, 0, None, _BYTES[data] ^ np.uint64(seed)
    size = 1
    while True:
        if length & size:
            if out is None:
                out = x
            else:
                n = min(len(out), len(x) - done)
                out = out[: max(n, 0)] * _FACTORS[32 + level] + x[done : done + max(n, 0)]
            done += size
        if size * 2 > length:
            break
        x = x[:-size] * _FACTORS[level] + x[size:] if len(x) > size else x[:0]
        size, level = size * 2, level + 1
    return mixed(out[: max(len(data) - length + 1, 0)])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, first window, number of windows, whether its own windows may repeat) of every stretch, chunk by chunk."""
    inner = width - INNER + 1
    place = np.uint64((1 << 22) - 1)
    for base in range(0, len(data) - width + 1, CHUNK):
        part = data[base : base + CHUNK + width - 1]
        hashes = string_hashes(part, INNER)
        # the smallest hash of each window, the leftmost one among equals
        at = sliding_minimum((hashes & ~place) | np.arange(len(hashes), dtype=np.uint64), inner) & place
        least = hashes[at]
        first = np.concatenate(([True], least[1:] != least[:-1]))
        start = np.flatnonzero(first)
        within = np.arange(len(least)) - np.repeat(start, np.diff(np.append(start, len(least))))
        start = np.flatnonzero(within % inner == 0)
        moved = np.concatenate(([0], (at[1:] != at[:-1]).astype(np.int64)))
        moved[start] = 0
        yield least[start].view(np.int64), start + base, np.diff(np.append(start, len(least))), np.add.reduceat(moved, start) > 0


def suffix_ranks(codes: np.ndarray) -> np.ndarray:
    """The rank of every suffix of a string whose suffixes differ before its end; by prefix doubling."""
    n = len(codes)
    bits = int(codes.max()).bit_length()
    packed = max(1, min(16, 63 // bits, n))
    key = np.zeros(n, np.int64)
    for j in range(packed):
        key <<= bits
        key[: n - j] |= codes[j:]
    tied = np.argsort(key)
    key = key[tied]
    rank = np.zeros(n, np.int64)
    depth = packed
    base = np.zeros(n, np.int64)
    while True:
        place = np.arange(len(tied))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.maximum.accumulate(np.where(new, place, 0))
        rank[tied] = base + head
        single = new & np.append(new[1:], True)
        tied, base = tied[~single], (base + head)[~single]
        if not len(tied):
            return rank
        # rows of one group stay together: sort by (group, rank further on)
        key = base * n + rank[np.minimum(tied + depth, n - 1)]
        order = np.argsort(key)
        tied, key, base = tied[order], key[order], base[order]
        # base + head must be the place in the whole: count from the start of the old group
        old = np.concatenate(([True], base[1:] != base[:-1]))
        base = base - np.maximum.accumulate(np.where(old, np.arange(len(tied)), 0))
        depth *= 2


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes from positions a and b on are equal, up to ``most``."""
    eight = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for j in range(8):
        eight |= padded[j : j + len(data)].astype(np.uint64) << np.uint64(8 * j)
    out, active = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
    while len(active):
        at = out[active]
        differ = eight[np.minimum(a[active] + at, len(data) - 1)] ^ eight[np.minimum(b[active] + at, len(data) - 1)]
        same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // 8).astype(np.int64)
        out[active] += same
        active = active[(same == 8) & (out[active] < most[active])]
    return np.minimum(out, most)


def matching_statistics(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every position of the joined segments the longest match inside segments that starts elsewhere.

    Also the position at which each segment starts; one separator follows each.
    """
    lengths = np.array([len(s) for s in segments])
    starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    ends = np.repeat(starts + lengths, lengths + 1)
    codes = data.astype(np.int64) + len(segments)
    codes[starts + lengths] = np.arange(len(segments))  # separators all differ
    rank = suffix_ranks(codes)
    suffix = np.empty_like(rank)
    suffix[rank] = np.arange(len(rank))
    transform = codes[suffix - 1]
    head = np.concatenate(([True], transform[1:] != transform[:-1]))  # run starts; the row before a head ends a run
    best = np.zeros(len(data), np.int64)
    always = np.zeros(len(data), bool)
    always[starts] = True
    for sampled, step in ((head, -1), (np.append(head[1:], True), 1)):
        marked = always.copy()
        marked[suffix[sampled]] = True
        at = np.flatnonzero(marked)  # samples in text order
        row = rank[at] + step
        inside = (row >= 0) & (row < len(suffix))
        other = suffix[np.clip(row, 0, len(suffix) - 1)]
        most = np.where(inside, np.minimum(ends[at] - at, ends[other] - other), 0)
        length = common_prefixes(data, at, other, most)
        sample = np.cumsum(marked) - 1  # the last sample at or before each position
        best = np.maximum(best, length[sample] - (np.arange(len(data)) - at[sample]))
    return best, starts


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], marked.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _spans(k_id, k_text, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(k_id, pa.int64()), pa.array(k_text, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
        ["k_id", "k_text", "start", "end"],
    )


SPANS = "k_id bigint, k_text bigint, start bigint, end bigint"


def _indexed(rows: DataFrame, width: int) -> DataFrame:
    """Spans of repeated windows among different stretches of one key (key, copies, k_id, k_text, start, bytes)."""

    def judge(block: list[tuple]) -> pa.RecordBatch:
        found: tuple[list, list, list, list] = ([], [], [], [])
        if block:
            best, starts = matching_statistics([row[4] for row in block])
            for (copies, k_id, k_text, start, piece), at in zip(block, starts):
                if copies == 1:
                    for a, b in zip(*_runs(best[at : at + len(piece) - width + 1] >= width)):
                        for column, value in zip(found, (k_id, k_text, start + int(a), start + int(b) - 1 + width)):
                            column.append(value)
        return _spans(*found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, last = [], 0, None
        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "copies", "k_id", "k_text", "start", "piece"))):
                if key != last and size > BLOCK:
                    yield judge(block)
                    block, size = [], 0
                last = key
                block.append(tuple(row))
                size += len(row[4]) + 1
        if block:
            yield judge(block)

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, SPANS)


def _by_fingerprints(rows: DataFrame, width: int) -> DataFrame:
    """The same for keys with too many stretches, by counting fingerprints of single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for copies, k_id, k_text, start, piece in zip(*(batch.column(c).to_pylist() for c in ("copies", "k_id", "k_text", "start", "piece"))):
                data = np.frombuffer(piece, np.uint8)
                one, two = string_hashes(data, width, 1).view(np.int64), string_hashes(data, width, 2).view(np.int64)
                n = len(one)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), pa.array(np.full(n, copies)), *_spans(np.full(n, k_id), np.full(n, k_text), np.arange(start, start + n), np.arange(start, start + n) + width).columns],
                    ["one", "two", "copies", "k_id", "k_text", "start", "end"],
                )

    windows = rows.mapInArrow(run, f"one bigint, two bigint, copies bigint, {SPANS}")
    repeated = windows.groupBy("one", "two").agg(F.sum("copies").alias("seen")).filter("seen > 1")
    return windows.filter("copies = 1").join(repeated, ["one", "two"]).select("k_id", "k_text", "start", "end")


def _cut_out(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The bytes of the wanted stretches (key, copies, nd, k_id, k_text, start, n)."""
    lists = wanted.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("key", "copies", "different", "start", "n")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k_id, k_text, text, found in zip(*(batch.column(c).to_pylist() for c in ("k_id", "k_text", "text", "wanted"))):
                data = text.encode("utf-8", "replace") if found and text else b""
                rows += [
                    (w["key"], w["copies"], w["different"], k_id, k_text, w["start"], data[w["start"] : w["start"] + w["n"] + width - 1])
                    for w in found or ()
                ]
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2000]), (*[pa.int64()] * 6, pa.binary()))],
                    ["key", "copies", "different", "k_id", "k_text", "start", "piece"],
                )

    joined = docs.select("k_id", "k_text", "text").join(lists, ["k_id", "k_text"], "left")
    return joined.mapInArrow(run, "key bigint, copies bigint, different bigint, k_id bigint, k_text bigint, start bigint, piece binary")


def repeated_spans(docs: DataFrame, width: int) -> DataFrame:
    """Byte spans (k_id, k_text, start, end; they may overlap) of all windows that also start elsewhere."""
    if width < 2 * INNER:
        raise ValueError(f"width must be {2 * INNER} or more")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k_id, k_text, text in zip(*(batch.column(c).to_pylist() for c in ("k_id", "k_text", "text"))):
                raw = (text or "").encode("utf-8", "replace")
                view = memoryview(raw)
                for key, start, n, again in stretches(np.frombuffer(raw, np.uint8), width):
                    digest = xxhash.xxh3_64_intdigest
                    same = np.array([digest(view[a : a + b]) for a, b in zip(start.tolist(), (n + width - 1).tolist())], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(same), pa.array(np.full(len(key), k_id)), pa.array(np.full(len(key), k_text)), pa.array(start), pa.array(n), pa.array(again)],
                        ["key", "same", "k_id", "k_text", "start", "n", "again"],
                    )

    found = docs.select("k_id", "k_text", "text").mapInArrow(cut, "key bigint, same bigint, k_id bigint, k_text bigint, start bigint, n bigint, again boolean")
    found = written(found, "stretches")
    one = found.groupBy("key", "same").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("k_id", "k_text", "start", "n", "again")])
    different = written(one, "different-stretches")
    copied = different.filter("copies > 1").select("key", "same")
    whole = found.join(copied, ["key", "same"]).select("k_id", "k_text", "start", (F.col("start") + F.col("n") + (width - 1)).alias("end"))
    keys = different.groupBy("key").agg(
        F.count("*").alias("different"), F.max(F.when(F.col("copies") == 1, 1)).alias("open"),
        F.max(F.when((F.col("copies") == 1) & F.col("again"), 1)).alias("again"),
    )
    wanted = different.join(keys.filter("different > 1 and open = 1 or again = 1").select("key", "different"), "key").drop("same", "again")
    pieces = written(_cut_out(docs, wanted, width), "stretch-bytes")
    indexed = _indexed(pieces.filter(F.col("different") <= LARGEST_GROUP).drop("different"), width)
    counted = _by_fingerprints(pieces.filter(F.col("different") > LARGEST_GROUP).drop("different"), width)
    return whole.unionByName(indexed).unionByName(counted)


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, the removed spans and what is left of every row as bytes, with its digest."""
    rows = keyed_rows(docs, id_col, text_col)
    lists = repeated_spans(rows, width).groupBy("k_id", "k_text").agg(F.collect_set(F.struct("start", "end")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
                raw = (text or "").encode("utf-8", "replace")
                spans = merged([f["start"] for f in found], [f["end"] for f in found]) if found else []
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                for column, value in zip(out, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [x for s in spans for x in s])):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.int64()))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    joined = rows.join(lists, ["k_id", "k_text"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>")
