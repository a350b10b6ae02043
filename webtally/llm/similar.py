"""Rows whose sets of word shingles have a Jaccard similarity of 0.8 or more, exactly (near-duplicate stage of the pipeline).

Prefix filter: shingles have one order over the whole corpus, common ones last. Two sets that are similar enough share a
shingle among the first fifth of each, so rows meet in the bucket of every shingle of their prefix, and the places of a
shared shingle bound how much can be shared at all. Then parity bits: each shingle of a set turns one bit over, so the bits
in which two sets differ are at most as many as the shingles that only one of them has, and similar sets differ in no more
than a ninth of their sizes' sum. 256 bits of each row are looked at in the bucket, twice as many bits as shingles for the
pairs that are left. Only then a pair is decided on the two whole sets, which are made again from the texts of those rows
alone. The order comes from a sample; any order gives the same result, a good one gives small buckets.

The groups that SimHash finds come first: each of their rows is decided against the smallest of its group, and what holds is
one component already. The rest is exact whatever they were.

A dense group would make the square of its size in pairs. So then a few drawn buckets of each row propose only their members
with one of them, the leader; what these verified links connect is one component. Then each row of a bucket proposes only the
row of another component that differs from it in the fewest parity bits for its size: a number in proportion to the bucket,
which ties what a leader missed. Then every pair of different components that passes the bounds is decided. Pairs inside a
component need no decision: the result is the components of all similar pairs.

Rows with the same set are one node; texts without words have the empty set and are one node too. Shingles and sets are
known by 64-bit hashes. Repeated rows share a node, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import discarded, keyed_rows, mixed, shuffle_partitions, texts_of, written
from .components import components
from .simhash import shingle_hashes

#: Slots of the order and of the filter of wanted texts, rows the order is learned from. None of them changes a result.
SLOT_BITS, FILTER_SLOTS, SAMPLED = 20, 1 << 23, 20_000
#: Rounds of leaders, then of nearest rows, before all pairs; buckets of a row in each round of leaders; buckets up to this
#: size are compared step by step; pairs and rows held at once. None of them changes a result.
ROUNDS, NEAREST, LED, SMALL, HELD = 1, 1, 4, 64, 200_000
#: Parity bits looked at in a bucket.
PARITY = 256


def token_set(text: str, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def similar(one: np.ndarray, two: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets of at least 4/5."""
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return 9 * shared >= 4 * (len(one) + len(two))


def shingle_levels(docs: DataFrame, size: int, id_col: str, text_col: str) -> np.ndarray:
    """How common the shingles of each slot are, as a power of two, in a sample of rows."""
    step = max(1, docs.count() // SAMPLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tokens = np.concatenate([token_set(t, size) for t in texts_of(batch)])
                slot, n = np.unique(tokens >> np.uint64(64 - SLOT_BITS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(n.astype(np.int64))], ["slot", "n"])

    sample = keyed_rows(docs, id_col, text_col).filter(F.pmod("k_text", F.lit(step)) == 0).select("text")
    counted = sample.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 3").toArrow()
    levels = np.zeros(1 << SLOT_BITS, np.uint8)
    levels[counted["slot"].to_numpy()] = np.log2(np.maximum(counted["n"].to_numpy(), 1)).astype(np.uint8)
    return levels


def _prefix(tokens: np.ndarray, levels: np.ndarray) -> bytes:
    """The first shingles in the order, as many as one of a similar set must be among."""
    if not len(tokens):
        return b""
    order = np.lexsort((tokens, levels[tokens >> np.uint64(64 - SLOT_BITS)]))
    return tokens[order[: len(tokens) - (4 * len(tokens) + 4) // 5 + 1]].tobytes()


def parity(tokens: np.ndarray) -> np.ndarray:
    """As many bits as the power of two from ``PARITY`` on that is twice the set's size or more, each turned over by its shingles."""
    size = max(PARITY, 1 << (2 * len(tokens) - 1).bit_length() if len(tokens) else 0)
    odd = np.bincount((tokens % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool))


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parity bits of a set as if there were only ``size`` bits."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size // 8), axis=0)


def may_be_similar(one: bytes, two: bytes, n: int) -> bool:
    """Whether sets of ``n`` shingles together, with these parity bits, can have a similarity of 4/5."""
    left, right = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    size = 8 * min(len(left), len(right))
    return 9 * int(np.bitwise_count(folded(left, size) ^ folded(right, size)).sum()) <= n


def _row_nodes(docs: DataFrame, size: int, levels: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row key, node, number of shingles, prefix and parity bits of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, prefix, bits, short = [], [], [], [], []
            for text in texts_of(batch):
                tokens = token_set(text, size)
                node.append(xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63)
                n.append(len(tokens))
                prefix.append(_prefix(tokens, levels))
                bits.append(parity(tokens).tobytes())
                short.append(folded(np.frombuffer(bits[-1], np.uint8), PARITY).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "k_id", "k_text")), pa.array(node, pa.int64()), pa.array(n, pa.int32()),
                    pa.array(prefix, pa.binary()), pa.array(bits, pa.binary()), pa.array(short, pa.binary()),
                ],
                ["doc_id", "k_id", "k_text", "node", "n", "prefix", "bits", "short"],
            )

    schema = "doc_id bigint, k_id bigint, k_text bigint, node bigint, n int, prefix binary, bits binary, short binary"
    return keyed_rows(docs, id_col, text_col).mapInArrow(run, schema)


def _whole(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by their first, cut only between its values."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            if sum(len(h[0]) for h in held) > HELD:
                columns = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(columns[0], columns[0][-1]))
                held = [[c[cut:] for c in columns]]
                if cut:
                    yield [c[:cut] for c in columns]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def _turns(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """In which rounds of leaders each key of a row takes part, as bits: those with the least hashes of the row's keys."""
    out = np.zeros(len(keys), np.int64)
    for salt in range(ROUNDS):
        order = np.lexsort((mixed(keys.view(np.uint64) ^ mixed(np.full(1, salt + 77, np.uint64))), row))
        start = np.maximum.accumulate(np.where(np.concatenate(([True], row[1:] != row[:-1])), np.arange(len(row)), 0)) if len(row) else row
        out[order[np.arange(len(row)) - start < LED]] |= 1 << salt
    return out


def _unpacked(info: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of shingles and room; the lowest bits of ``info`` are the turns, then come the place and the number."""
    n, place = info >> 32, (info >> 4) & ((1 << 28) - 1)
    return n, 9 * (n - place) - 4 * n


def buckets(nodes: DataFrame) -> DataFrame:
    """key, node and info of each node in the buckets in which a pair may meet.

    Sets x and y with a first shared shingle at places i and j share at most min(n_x - i, n_y - j), and similar ones at
    least 4/9 (n_x + n_y): so they need room_x >= 4 n_y and room_y >= 4 n_x, with room = 9 (n - place) - 4 n.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
                many = np.array([len(p) for p in parts])
                keys, row = np.concatenate(parts), np.repeat(np.arange(len(many)), many)
                place = np.arange(len(keys)) - np.repeat(np.cumsum(many) - many, many)
                n = np.repeat(batch.column("n").to_numpy().astype(np.int64), many)
                columns = [keys, np.repeat(batch.column("node").to_numpy(), many), n << 32 | place << 4 | _turns(keys, row)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "info"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole(batches, ("key", "node", "info")):
            starts = _starts(columns[0])
            sizes = np.diff(np.append(starts, len(columns[0])))
            n, room = _unpacked(columns[2])
            stays = np.repeat((sizes > 1) & np.logical_or.reduceat(room >= 4 * n, starts), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(c[stays]) for c in columns], ["key", "node", "info"])

    schema = "key bigint, node bigint, info bigint"
    dealt = nodes.select("node", "n", "prefix").mapInArrow(deal, schema)
    return dealt.repartition(shuffle_partitions(dealt.sparkSession), "key").sortWithinPartitions("key").mapInArrow(shared, schema)


def leader_pairs(key, node, n, room, label, bits, salt: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with the leader of its bucket; the least of hashes that are the same everywhere leads."""
    starts = _starts(key)
    sizes = np.diff(np.append(starts, len(key)))
    rank = mixed(node.view(np.uint64) ^ mixed(np.full(1, salt + 1, np.uint64)))
    lead = np.repeat(np.lexsort((rank, np.repeat(np.arange(len(starts)), sizes)))[starts], sizes)
    b = np.flatnonzero((label != label[lead]) & (room >= 4 * n[lead]) & (room[lead] >= 4 * n))
    yield lead[b], b


def all_pairs(key, node, n, room, label, bits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of a bucket that has different labels and room; rows are sorted by key and n."""
    starts = _starts(key)
    sizes = np.diff(np.append(starts, len(key)))
    split = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
    a, step = np.flatnonzero(np.repeat(split & (sizes <= SMALL), sizes)), 0
    while len(a):
        step += 1
        a = a[a + step < len(key)]
        # n only grows from here on: a row that has no room for the next has none for later ones
        a = a[(key[a + step] == key[a]) & (room[a] >= 4 * n[a + step])]
        near = a[(label[a + step] != label[a]) & (room[a + step] >= 4 * n[a])]
        yield near, near + step
    for start, size in zip(starts[split & (sizes > SMALL)], sizes[split & (sizes > SMALL)]):
        here = np.arange(start, start + size)
        names, many = np.unique(label[here], return_counts=True)
        main = label[here] == names[np.argmax(many)]
        for row in here[~main]:
            # inside the largest component nothing is to be decided; of two other rows the first one asks
            asked = (main | (here > row)) & (label[here] != label[row]) & (room[here] >= 4 * n[row]) & (room[row] >= 4 * n[here])
            yield np.full(int(asked.sum()), row), here[asked]


def differing(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many parity bits the rows differ."""
    return np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)


def nearest_pairs(key, node, n, room, label, bits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with one row of another label in its bucket, that with the fewest differing parity bits for the sizes."""
    none = np.iinfo(np.int64).max
    best = np.full(len(key), none)
    for a, b in all_pairs(key, node, n, room, label, bits):
        # at most 0 where the bits leave the pair; the other row's place goes into the low half
        over = 9 * differing(bits, a, b) - n[a] - n[b]
        a, b, over = a[over <= 0], b[over <= 0], over[over <= 0]
        np.minimum.at(best, a, over * 2**32 + b)
        np.minimum.at(best, b, over * 2**32 + a)
    rows = np.flatnonzero(best != none)
    yield rows, best[rows] & (2**32 - 1)


def proposed(dealt: DataFrame, marks: DataFrame, labels: DataFrame | None, pairs: Callable, turn: int | None) -> DataFrame:
    """Distinct pairs of nodes ``a`` < ``b`` of different components, with the numbers of their shingles together.

    ``marks`` has the parity bits of the nodes (node, short). Of a round of leaders only its ``turn`` takes part.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, info, short, label in _whole(batches, ("key", "node", "info", "short", "label")):
            (n, room), held = _unpacked(info), []
            bits = np.frombuffer(b"".join(short.tolist()), np.uint64).reshape(len(node), -1)
            for a, b in pairs(key, node, n, room, label, bits):
                near = 9 * differing(bits, a, b) <= n[a] + n[b]
                a, b = a[near], b[near]
                held.append((node[a], node[b], n[a] + n[b]))
                if sum(len(h[0]) for h in held) > HELD:
                    yield packed(held)
                    held = []
            if held:
                yield packed(held)

    def packed(held):
        one, two, n = (np.concatenate([h[i] for h in held]) for i in range(3))
        found = np.unique(np.column_stack([np.minimum(one, two), np.maximum(one, two), n]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(3)], ["a", "b", "n"])

    rows = dealt if turn is None else dealt.filter(F.col("info").bitwiseAND(1 << turn) != 0)
    rows = rows.join(marks, "node")
    rows = rows.withColumn("label", F.col("node")) if labels is None else rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = rows.select("key", "node", "info", "short", "label").repartition(shuffle_partitions(dealt.sparkSession), "key")
    return rows.sortWithinPartitions("key", "info").mapInArrow(meet, "a bigint, b bigint, n bigint").distinct()


def filtered(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs that all parity bits of their nodes (node, bits) leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, n = (batch.column(c).to_pylist() for c in ("one", "two", "n"))
            yield batch.select(["a", "b"]).filter(pa.array([may_be_similar(*x) for x in zip(one, two, n)], pa.bool_()))

    ends = pairs.join(marks.select(F.col("node").alias("a"), F.col("bits").alias("one")), "a")
    ends = ends.join(marks.select(F.col("node").alias("b"), F.col("bits").alias("two")), "b")
    return ends.select("a", "b", "n", "one", "two").mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """node and set of the wanted nodes (``node``, ``k_id``, ``k_text``), from one of their rows each."""
    slots = wanted.select(F.pmod("k_text", F.lit(FILTER_SLOTS)).alias("s")).distinct().toArrow()["s"].to_numpy()
    some = np.zeros(FILTER_SLOTS, bool)
    some[slots] = True
    bits = np.packbits(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.unpackbits(bits).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(asked[batch.column("k_text").to_numpy() % FILTER_SLOTS]))
            sets = pa.array([token_set(t, size).tobytes() for t in texts_of(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("k_id"), batch.column("k_text"), sets], ["k_id", "k_text", "tokens"])

    made = keyed_rows(docs, id_col, text_col).mapInArrow(run, "k_id bigint, k_text bigint, tokens binary")
    return made.join(wanted, ["k_id", "k_text"]).select("node", "tokens").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("one"), batch.column("two")
            yes = [similar(np.frombuffer(one[i].as_buffer(), np.uint64), np.frombuffer(two[i].as_buffer(), np.uint64)) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    ends = pairs.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("two")), "b")
    ends = ends.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("one")), "a")
    return ends.select("a", "b", "one", "two").mapInArrow(run, "a bigint, b bigint")


def group_pairs(groups: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs of nodes ``a`` < ``b`` with the numbers of their shingles together: each node of a group with its smallest.

    ``groups`` has the component of every row (k_id, k_text), ``marks`` one row of each node.
    """
    near = groups.select("k_id", "k_text", "component").distinct().join(marks.select("node", "n", "k_id", "k_text"), ["k_id", "k_text"])
    least = near.groupBy("component").agg(F.min(F.struct("node", "n")).alias("least"))
    pairs = near.join(least, "component").where(F.col("node") != F.col("least.node"))
    return pairs.select(F.col("least.node").alias("a"), F.col("node").alias("b"), (F.col("least.n") + F.col("n")).cast("bigint").alias("n"))


def similar_groups(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """doc_id, row key and ``component``, a number shared by the rows that similar pairs connect.

    ``groups`` proposes what is decided first: the rows (k_id, k_text) of a ``component`` of another method, as SimHash.
    """
    levels = shingle_levels(docs, size, id_col, text_col)
    rows = written(_row_nodes(docs, size, levels, id_col, text_col), "shingles")
    dealt = written(buckets(rows.select("node", "n", "prefix").dropDuplicates(["node"])), "buckets")
    places = rows.groupBy("node").agg(F.min(F.struct("k_id", "k_text")).alias("s"))
    places = places.join(dealt.select("node").distinct(), "node").select("node", "s.k_id", "s.k_text")
    marks = rows.select("node", "n", "k_id", "k_text", "bits", "short").join(places, ["node", "k_id", "k_text"]).dropDuplicates(["node"])
    marks = written(marks, "marks")
    shorts = marks.select("node", "short")
    found, labels = None, None
    rounds = [(lambda *columns, salt=salt: leader_pairs(*columns, salt), salt) for salt in range(ROUNDS)]
    given = [] if groups is None else [(None, None)]
    for pairs, turn in [*given, *rounds, *[(nearest_pairs, None)] * NEAREST, (all_pairs, None)]:
        candidates = group_pairs(groups, marks) if pairs is None else proposed(dealt, shorts, labels, pairs, turn)
        left = written(filtered(candidates, marks), "pairs")
        if labels is not None and left.isEmpty():
            discarded(left)
            continue
        asked = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = written(marks.select("node", "k_id", "k_text").join(asked, "node"), "wanted")
        sets = written(_sets(docs, wanted, size, id_col, text_col), "sets")
        new = written(verified(left, sets), "links")
        found = new if found is None else found.unionByName(new)
        before, labels = labels, components(found)
        discarded(left, wanted, sets, *([before] if before is not None else []))
    joined = rows.join(labels.withColumnRenamed("label", "component"), "node", "left")
    return joined.select("doc_id", "k_id", "k_text", F.coalesce("component", "node").alias("component"))
