"""Near duplicates by SimHash with pivot distance tables (operator 5).

Rows with equal fingerprints are one node. Nodes meet in buckets: for an exact search the fingerprint is cut into blocks
and a bucket holds what agrees in some of them, chosen so that fingerprints within the radius agree in at least one
choice; for a wide radius on long fingerprints a bucket is a drawn set of bits. In a bucket every fingerprint has its
distances to fixed pivot fingerprints in a table; by the triangle inequality a pair whose distances to one pivot differ by
more than the radius cannot be a link, and only pairs that pass are compared bit by bit. A large bucket is walked breadth
first, comparing each reached fingerprint with those not reached yet: it emits a tree, not its pairs, and a dense bucket
takes time near its size.

Null and empty texts have fingerprint zero and are linked like any others. Repeated rows share a node. Null ids are
ignored when the smallest id of a component is taken, unless it has no other. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import NO_ID, discarded, keyed_rows, mixed, shuffle_partitions, texts_of, written
from .components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
PIVOTS = 16
#: Buckets up to this size are compared pair by pair, larger ones walked.
SMALL = 32
#: Bucket rows a task holds at once, unless a single bucket is larger.
HELD = 200_000


def shingle_hashes(text: str, size: int) -> np.ndarray:
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[size - 1 :]
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def fingerprint(hashes: np.ndarray, bits: int = 64) -> bytes:
    """Bit by bit the majority of the hashes; beyond 64 bits of hashes of them."""
    out = b""
    for part in range(bits // 64):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 1 << 15):
            chunk = hashes[i : i + (1 << 15)]
            if part:
                chunk = mixed(chunk + np.uint64(part * 0x9E3779B97F4A7C15 % 2**64))
            ones += np.unpackbits(chunk.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out += np.packbits(2 * ones > len(hashes)).tobytes()
    return out


def fingerprints(docs: DataFrame, size: int, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the row key, the fingerprint and its node for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(shingle_hashes(t, size), bits) for t in texts_of(batch)]
            node = nodes_of(np.frombuffer(b"".join(fp), ">u8").astype(np.uint64).reshape(-1, bits // 64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "k_id", "k_text")), pa.array(fp, pa.binary()), pa.array(node)], ["doc_id", "k_id", "k_text", "fp", "node"]
            )

    return keyed_rows(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, k_id bigint, k_text bigint, fp binary, node bigint")


def block_keys(radius: int, blocks: int, agree: int) -> Callable[[np.ndarray], Iterator[np.ndarray]]:
    """Bucket keys of 64-bit fingerprints: every choice of ``agree`` blocks. Exact if blocks >= radius + agree."""
    if blocks < radius + agree:
        raise ValueError("fingerprints within the radius may agree in no choice of blocks")
    edges = [round(64 * b / blocks) for b in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]

    def keys(words: np.ndarray) -> Iterator[np.ndarray]:
        for n, chosen in enumerate(combinations(masks, agree)):
            yield mixed((words[:, 0] & np.uint64(sum(chosen))) ^ mixed(np.full(1, n + 1, np.uint64)))

    return keys


def _words(column: pa.Array, bits: int) -> np.ndarray:
    """Fingerprints of a batch as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, bits // 64)


def _binary(words: np.ndarray) -> pa.Array:
    width = words.shape[1] * 8
    offsets = np.arange(len(words) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(words.astype(">u8").tobytes())])


def nodes_of(words: np.ndarray) -> np.ndarray:
    """The node of each fingerprint: itself, or a 64-bit hash of a longer one."""
    if words.shape[1] == 1:
        return words[:, 0].view(np.int64)
    node = np.zeros(len(words), np.uint64)
    for j in range(words.shape[1]):
        node = mixed(node * np.uint64(0x9E3779B97F4A7C15) + words[:, j])
    return node.view(np.int64)


class PivotTable:
    """Distances of fingerprints to fixed pivots."""

    def __init__(self, words: np.ndarray, radius: int):
        rng = np.random.default_rng(17)
        self.words, self.radius = words, radius
        self.table = np.empty((len(words), PIVOTS), np.int16)
        for p in range(PIVOTS):
            pivot = rng.integers(0, 2**64, words.shape[1], dtype=np.uint64)
            self.table[:, p] = np.bitwise_count(words ^ pivot).sum(1, dtype=np.int16)

    def links(self, a, b) -> np.ndarray:
        """Which of the pairs (rows a, rows b) are within the radius; either may be one row."""
        left = np.broadcast_to(np.asarray(a), np.broadcast(a, b).shape)
        right = np.broadcast_to(np.asarray(b), left.shape)
        near = np.arange(len(left))
        for p in range(PIVOTS):
            column = self.table[:, p]
            near = near[np.abs(column[left[near]] - column[right[near]]) <= self.radius]
            if not len(near):
                break
        apart = np.bitwise_count(self.words[left[near]] ^ self.words[right[near]]).sum(1, dtype=np.int32)
        found = np.zeros(len(left), bool)
        found[near[apart <= self.radius]] = True
        return found


def bucket_links(keys: np.ndarray, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows a, rows b) that connect what is connected inside each bucket; keys are sorted."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    table = PivotTable(words, radius)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, min(SMALL, int(sizes.max(initial=1)))):
        a = np.flatnonzero(small[:-step] & (keys[step:] == keys[:-step]))
        if len(a):
            a = a[table.links(a, a + step)]
            found.append((a, a + step))
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        waiting, reached = np.arange(start, start + size), [start]
        waiting = waiting[1:]
        while len(waiting):
            row = reached.pop() if reached else waiting[0]
            if row == waiting[0]:
                waiting = waiting[1:]
            hit = table.links(row, waiting) if len(waiting) else np.zeros(0, bool)
            new = waiting[hit]
            if len(new):
                found.append((np.full(len(new), row), new))
                reached.extend(new.tolist())
                waiting = waiting[~hit]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def stars(a: np.ndarray, b: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Rows (smaller, node): what links (rows a, rows b) connect, each node tied to the smallest it is connected with."""
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[a], label[b])
        moved = label.copy()
        np.minimum.at(moved, a, low)
        np.minimum.at(moved, b, low)
        moved = moved[moved]
        if np.array_equal(moved, label):
            break
        label = moved
    least = node.copy()
    np.minimum.at(least, label, node)
    tied = np.column_stack([least[label], node])
    return np.unique(tied[tied[:, 0] != tied[:, 1]], axis=0)


def links(distinct: DataFrame, bits: int, radius: int, keys: Callable[[np.ndarray], Iterator[np.ndarray]]) -> DataFrame:
    """Links that connect distinct fingerprints (``fp``) as pairs of nodes ``a`` < ``b``.

    A bucket ties each node to one smaller node, so a node has at most as many smaller neighbours as there are keys.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = _words(batch.column("fp"), bits)
                column = _binary(words)
                for key in keys(words):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), column], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(held, final):
            keys_, words = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            cut = len(keys_) if final else int(np.searchsorted(keys_, keys_[-1]))
            rest = [(keys_[cut:], words[cut:])] if cut < len(keys_) else []
            if cut == 0:
                return rest, None
            a, b = bucket_links(keys_[:cut], words[:cut], radius)
            pairs = stars(a, b, nodes_of(words[:cut]))
            return rest, pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("key").to_numpy(zero_copy_only=False), _words(batch.column("fp"), bits)))
                if sum(len(h[0]) for h in held) > HELD:
                    held, out = done(held, False)
                    if out is not None:
                        yield out
        if held:
            yield done(held, True)[1]

    dealt = distinct.select("fp").mapInArrow(deal, "key bigint, fp binary")
    sorted_ = dealt.repartition(shuffle_partitions(dealt.sparkSession), "key").sortWithinPartitions("key")
    return sorted_.mapInArrow(meet, "a bigint, b bigint")


def merged_stars(pairs: DataFrame) -> DataFrame:
    """The same connections with fewer links: the smaller neighbours of a node are tied to the smallest of them.

    Buckets repeat the links of a dense group once a key, each around another node; here they fall together. The list of
    a node is bounded by the number of keys.
    """
    around = pairs.groupBy("b").agg(F.collect_set("a").alias("smaller"), F.min("a").alias("a"))
    others = F.filter(F.array_append("smaller", F.col("b")), lambda n: n != F.col("a"))
    return around.select("a", F.explode(others).alias("b")).distinct()


def grouped(docs: DataFrame, size: int, bits: int, radius: int, keys, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row key, fingerprint and ``component``, a number that connected rows share."""
    rows = written(fingerprints(docs, size, bits, id_col, text_col), "fingerprints")
    found = components(merged_stars(links(rows.select("fp").distinct(), bits, radius, keys)))
    joined = rows.join(found.withColumnRenamed("label", "component"), "node", "left")
    return joined.select("doc_id", "k_id", "k_text", "fp", F.coalesce("component", "node").alias("component"))


def fingerprint_groups(docs: DataFrame, size: int, radius: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``grouped`` for 64-bit fingerprints, exact within the radius."""
    return written(grouped(docs, size, 64, radius, block_keys(radius, radius + 3, 3), id_col, text_col), "components")


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of every row; 64-bit fingerprints, exact within the radius."""
    rows = fingerprint_groups(docs, size, radius, id_col, text_col)
    first = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(first, "component").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which each group of near duplicates keeps the smallest id.

    Near duplicates have sets of ``size``-word shingles with a Jaccard similarity of 0.8 or more; a group is what such
    pairs connect. The operator's groups, of fingerprints that differ in ``radius`` bits or fewer, come first, and each
    row of them is decided on the sets themselves; then what fingerprints cannot tell is searched for on the sets.
    """
    from .similar import similar_groups  # it uses the shingles of this module

    near = fingerprint_groups(docs, size, radius, id_col, text_col)
    rows = written(similar_groups(docs, size, id_col, text_col, near), "groups")
    discarded(near)
    stays = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "k_id", "k_text")).alias("s"))
    stays = stays.select(F.col("s.k_id").alias("id"), F.col("s.k_text").alias("hash"))
    # all columns of the rows travel as one, so that none can have the name of another one here
    held = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    kept = held.join(stays, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
