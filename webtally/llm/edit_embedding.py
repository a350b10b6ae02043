"""Document fingerprints by a randomised embedding of the edit distance (operator 12).

A walk reads a text: at every step it writes the character it stands on and then stays or goes on by one, as a random
function says that all texts share and that looks only at the step and the character. Texts that differ by an edit fall back
into step soon after it, so the walks' outputs differ in few places where the texts are few edits apart: the edit distance
has become a Hamming distance. A fingerprint keeps four bits of the output at drawn steps, the same for all texts.

Texts of any length are walked as a whole. So that texts of every length have as many drawn steps, steps are drawn for each
*scale*, a power of two of characters; a fingerprint has the scale that holds its text and the next one, so that texts of
neighbouring scales can be compared too. ``likeness`` is the share of equal entries among the steps at which not both walks
have ended; texts whose lengths are scales apart have likeness 0, two empty texts 1.

``near_texts`` finds pairs: a band is a few drawn entries of one scale, texts that agree in a band are candidates, and every
candidate is verified by the likeness of the fingerprints. Equal fingerprints are one node; a band is walked breadth first,
so that it emits a tree of links and not all pairs of a group.

Null texts count as empty. Rows are ordered by id, null ids first, then by a hash of the text, then as they are stored; the
row after the last is the first. The table is read twice and must give its rows in the same order both times, as a stored one
does. An empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import NO_ID, mixed, shuffle_partitions, texts_of, written
from .components import components

#: Walks, drawn steps of each walk and scale, classes of characters, steps after which the random function repeats.
WALKS, DRAWN, CLASSES, PERIOD = 2, 128, 64, 1024
#: A walk of n characters takes about 2 n steps; steps are drawn up to this multiple of a scale.
REACH = 2.25
#: Characters walked at once.
TOGETHER = 4 << 20
#: Entries in a band and bands of a fingerprint.
ENTRIES, BANDS = 6, 24
SMALLEST = 4
#: Row keys from which range boundaries are drawn, for each range.
DRAWN_KEYS = 32


def _stays() -> np.ndarray:
    """For each walk, class and step the steps until the walk goes on, at least one."""
    goes = np.random.default_rng(12).integers(0, 2, (WALKS, CLASSES, PERIOD), dtype=np.uint8)
    goes[:, :, -1] = 1  # every walk goes on at least once in a period
    out = np.zeros((WALKS, CLASSES, PERIOD), np.int64)
    ahead = np.ones((WALKS, CLASSES), np.int64)
    for step in (*range(PERIOD - 1, -1, -1), *range(PERIOD - 1, -1, -1)):
        ahead = np.where(goes[:, :, step] == 1, 1, ahead + 1)
        out[:, :, step] = ahead
    return out


STAYS = _stays()


def scale_of(n: int) -> int:
    """The exponent of the smallest power of two that is ``n`` or more, from ``SMALLEST`` on."""
    return max(SMALLEST, (n - 1).bit_length() if n > 1 else 0)


@cache
def drawn_steps(walk: int, scale: int) -> np.ndarray:
    return np.sort(np.random.default_rng([12, walk, scale]).integers(0, int(REACH * 2**scale), DRAWN))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _rows_of(characters: np.ndarray, walk: int) -> np.ndarray:
    """Where the table of a walk has the row of each character."""
    return (mixed(characters.astype(np.uint64) + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int32) * PERIOD


def _walked(codes: list[np.ndarray], walk: int) -> list[np.ndarray]:
    """For each text the steps at which the walk comes to each of its characters, and at which it ends; longest texts first."""
    lengths = np.array([len(c) for c in codes])
    starts = np.cumsum(lengths + 1) - lengths - 1  # one more place for the end
    rows = _rows_of(np.concatenate([x for c in codes for x in (c, np.zeros(1, np.uint32))]), walk)
    arrivals, table, step = np.zeros(len(rows), np.int32), STAYS[walk].ravel(), np.zeros(len(codes), np.int64)
    # how many texts are longer than i: those go on from their i-th character
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left").tolist()
    for i, n in enumerate(alive):
        place = starts[:n] + i
        step[:n] += table[rows[place] + (step[:n] & (PERIOD - 1))]
        arrivals[place + 1] = step[:n]
    return [arrivals[a : a + n + 1] for a, n in zip(starts.tolist(), lengths.tolist())]


def fingerprints(texts: list[str]) -> list[bytes]:
    """The fingerprint of each text: its scale, then for it and the next one the entries of all walks, four bits each."""
    out: list[bytes] = [bytes([SMALLEST]) + bytes(WALKS * DRAWN)] * len(texts)
    order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        end, size = at, 0
        while end < len(order) and (end == at or size + len(texts[order[end]]) <= TOGETHER):
            size += len(texts[order[end]])
            end += 1
        codes = [code_points(texts[i]) for i in order[at:end]]
        entries = [np.stack([_entries(c, a, walk) for c, a in zip(codes, _walked(codes, walk))]) for walk in range(WALKS)]
        together = np.stack(entries, axis=2).reshape(len(codes), -1)  # text, scale, walk, step
        packed = together[:, ::2] << 4 | together[:, 1::2]
        for i, c, row in zip(order[at:end], codes, packed):
            out[i] = bytes([scale_of(len(c))]) + row.tobytes()
        at = end
    return out


def _entries(characters: np.ndarray, arrivals: np.ndarray, walk: int) -> np.ndarray:
    """What the walk wrote at the drawn steps of the two scales, as 1 to 15; 0 after its end."""
    scale = scale_of(len(characters))
    steps = np.concatenate([drawn_steps(walk, s) for s in (scale, scale + 1)])
    place = np.searchsorted(arrivals, steps, "right") - 1
    written_ = characters[np.minimum(place, len(characters) - 1)].astype(np.uint64)
    entry = mixed(written_ * np.uint64(3) + np.uint64(walk + 1)) % np.uint64(15) + np.uint64(1)
    return np.where(place < len(characters), entry, 0).astype(np.uint8).reshape(2, DRAWN)


def _levels(fingerprint: bytes) -> tuple[int, np.ndarray]:
    """The scale and the entries of it and of the next one."""
    packed = np.frombuffer(fingerprint, np.uint8)[1:]
    return fingerprint[0], np.column_stack([packed >> 4, packed & 15]).reshape(2, -1)


def likeness(one: bytes, two: bytes) -> float:
    """The share of equal entries among those at which not both walks have ended, on the larger scale of the two."""
    (a, left), (b, right) = _levels(one), _levels(two)
    top = max(a, b)
    if top - min(a, b) > 1:
        return 0.0
    left, right = left[top - a], right[top - b]
    some = (left > 0) | (right > 0)
    return float((left == right)[some].mean()) if some.any() else 1.0


def edited(text: str, following: str) -> str:
    """The text whose last half, rounded down, gives way to as many first code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


# -- pairs of consecutive rows -------------------------------------------------


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the three parts of a row's place in the order, none of them null."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("k_id"), F.xxhash64(F.col(text_col).cast("string")).alias("k_text"),
        F.monotonically_increasing_id().alias("k_row"),
    )


def _structured(*columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns[0]), [("id", "<i8"), ("text", "<i8"), ("row", "<i8")])
    for name, column in zip(out.dtype.names, columns):
        out[name] = column
    return out


def _of(batch: pa.RecordBatch) -> np.ndarray:
    return _structured(*(batch.column(c).to_numpy() for c in ("k_id", "k_text", "k_row")))


def consecutive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt to ranges of the order (``range``), each range with the first row of the next one (``lent``).

    Boundaries come from drawn keys. A range is not more than some rows of its neighbours' size even where one id, or one
    id and text, holds a third of all rows: the place of a row in the table is the last part of its key.
    """
    rows = _keys(docs, id_col, text_col)
    keys = written(rows.select("k_id", "k_text", "k_row"), "row-keys")
    n, ranges = keys.count(), shuffle_partitions(docs.sparkSession)
    step = max(1, n // (DRAWN_KEYS * ranges))
    drawn = keys.filter(F.pmod(F.xxhash64("k_id", "k_text", "k_row"), F.lit(step)) == 0).toArrow()
    drawn = np.sort(_structured(*(drawn[c].to_numpy() for c in ("k_id", "k_text", "k_row"))))
    bounds = drawn[np.arange(1, ranges) * len(drawn) // ranges] if len(drawn) >= ranges else drawn

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _of(batch)
            order = np.argsort(key)
            place = np.searchsorted(bounds, key[order], "right")
            heads = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else place
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[heads].astype(np.int32)), *(pa.array(key[order][heads][c]) for c in key.dtype.names)], ["range", "k_id", "k_text", "k_row"]
            )

    heads = keys.mapInArrow(first, "range int, k_id bigint, k_text bigint, k_row bigint")
    heads = heads.groupBy("range").agg(F.min(F.struct("k_id", "k_text", "k_row")).alias("k")).select("range", "k.*").orderBy("range").toArrow()
    firsts = _structured(*(heads[c].to_numpy() for c in ("k_id", "k_text", "k_row")))
    before = np.roll(heads["range"].to_numpy(), 1)  # the range that asks for each first row

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = _of(batch)
                own = np.searchsorted(bounds, key, "right").astype(np.int32)
                at = np.minimum(np.searchsorted(firsts, key), len(firsts) - 1)
                lent = np.flatnonzero(firsts[at] == key)
                yield _ranged(batch, own, False)
                if len(lent):
                    yield _ranged(batch.take(pa.array(lent)), before[at[lent]], True)

    def _ranged(batch: pa.RecordBatch, ranges: np.ndarray, lent: bool) -> pa.RecordBatch:
        columns = [pa.array(ranges, pa.int32()), pa.array([lent] * batch.num_rows, pa.bool_()), *batch.columns]
        return pa.RecordBatch.from_arrays(columns, ["range", "lent", *batch.schema.names])

    schema = "range int, lent boolean, doc_id bigint, text string, k_id bigint, k_text bigint, k_row bigint"
    dealt = rows.mapInArrow(deal, schema).repartition(ranges, "range")
    return dealt.sortWithinPartitions("range", "lent", "k_id", "k_text", "k_row")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row its fingerprint, that of its edited text, and how alike these and the next row's are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, which waits for its next one
        for batch in batches:
            texts = texts_of(batch)
            rows = list(zip(batch.column("range").to_pylist(), batch.column("lent").to_pylist(), batch.column("doc_id").to_pylist(), texts, fingerprints(texts)))
            rows = [held, *rows] if held is not None else rows
            held = rows[-1] if rows else None
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1]]
            changed = [edited(a[3], b[3]) for a, b in pairs]
            marks = fingerprints(changed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed], pa.string()),
                    pa.array([a[4].hex() for a, _ in pairs], pa.string()), pa.array([m.hex() for m in marks], pa.string()),
                    pa.array([likeness(a[4], m) for (a, _), m in zip(pairs, marks)], pa.float64()),
                    pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return consecutive(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


# -- near texts ----------------------------------------------------------------


def band_keys(fingerprint: bytes) -> list[int]:
    """The bands of a fingerprint: drawn entries of each of its scales; entries after the end of a text do not count."""
    scale, levels = _levels(fingerprint)
    chosen = np.random.default_rng(24).integers(0, levels.shape[1], (BANDS, ENTRIES))
    keys = []
    for level, entries in zip((scale, scale + 1), levels):
        for band in range(BANDS):
            part = entries[chosen[band]]
            if (part > 0).sum() * 2 >= ENTRIES:
                keys.append(xxhash.xxh3_64_intdigest(bytes([level, band]) + part.tobytes()) - 2**63)
    return keys or [xxhash.xxh3_64_intdigest(fingerprint) - 2**63]


def tree(marks: list[bytes], least: float) -> Iterator[tuple[int, int]]:
    """Links (places in ``marks``) that connect what pairs of a likeness of ``least`` or more connect."""
    scales = np.array([m[0] for m in marks])
    levels = np.stack([_levels(m)[1] for m in marks])
    waiting, reached = np.arange(1, len(marks)), [0]
    while len(waiting):
        if not reached:
            reached, waiting = [int(waiting[0])], waiting[1:]
        row = reached.pop()
        for apart, mine, theirs in ((0, 0, 0), (1, 1, 0), (-1, 0, 1)):
            other = waiting[scales[waiting] - scales[row] == apart]
            left, right = levels[row, mine], levels[other, theirs]
            some = (left > 0) | (right > 0)
            alike = ((left == right) & some).sum(1) / np.maximum(some.sum(1), 1)
            new = other[(alike >= least) | ~some.any(1)]
            yield from ((row, int(n)) for n in new)
            reached.extend(new.tolist())
            waiting = waiting[~np.isin(waiting, new)]


def near_texts(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``group_id``, the smallest id that near pairs connect, of every row.

    A pair is near if it shares a band and its fingerprints have a likeness of ``least`` or more.
    """
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = fingerprints(texts_of(batch))
            node = [xxhash.xxh3_64_intdigest(m) - 2**63 for m in marks]
            columns = [batch.column("doc_id"), pa.array(node, pa.int64()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "mark"])

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(m) for m in batch.column("mark").to_pylist()]
            take = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), [len(k) for k in keys])))
            band = pa.array([k for ks in keys for k in ks], pa.int64())
            yield pa.RecordBatch.from_arrays([band, take.column("node"), take.column("mark")], ["band", "node", "mark"])

    def linked(nodes: list[int], marks: list[bytes]) -> pa.RecordBatch:
        pairs = [(nodes[x], nodes[y]) for x, y in tree(marks, least)] if len(nodes) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, nodes, marks = None, [], []
        for batch in batches:
            for key, node, fp in zip(*(batch.column(c).to_pylist() for c in ("band", "node", "mark"))):
                if key != band:
                    yield linked(nodes, marks)
                    band, nodes, marks = key, [], []
                nodes.append(node)
                marks.append(fp)
        yield linked(nodes, marks)

    rows = written(named.mapInArrow(mark, "doc_id bigint, node bigint, mark binary"), "marks")
    nodes = rows.groupBy("node").agg(F.first("mark").alias("mark"))
    dealt = nodes.mapInArrow(bands, "band bigint, node bigint, mark binary").repartition(shuffle_partitions(docs.sparkSession), "band")
    labels = components(dealt.sortWithinPartitions("band").mapInArrow(meet, "a bigint, b bigint")).withColumnRenamed("label", "group")
    joined = rows.drop("mark").join(labels, "node", "left").withColumn("group", F.coalesce("group", "node"))
    least_id = joined.groupBy("group").agg(F.min("doc_id").alias("group_id"))
    return joined.join(least_id, "group").select("doc_id", "group_id")
