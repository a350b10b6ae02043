"""Repeated word windows found from fixed-block anchors (operator 4).

Every text is cut into blocks of 7 words that do not overlap; any window of 13 words holds one whole block. The blocks are
the index. Every rolling window of 7 words probes it, and where a block is met the windows of 13 words around it are
extended word by word into exact keys; the smallest document of each key decides, and marked windows join to maximal
removed runs.

Keys of single windows are as many as the words of the corpus, so they travel packed: documents are dealt into groups,
each group sends one sorted and compressed array of keys to each bucket of the key space, and the bucket answers every
group with those of its keys that matter. Equal keys of a group are one entry, so a bucket receives each key at most once
from each group, however many copies a window has. Groups and buckets hold a share of the corpus each, by hash.

Null and empty texts have no words. A null id is smaller than any other. Rows that repeat in id do not remove each other.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NO_ID, SPACES, document_rows, window_hashes, word_hashes, word_spans

#: Text bytes hashed at once.
CHUNK = 1 << 18
#: Groups of documents for each partition of the input; a group is what one task holds.
GROUPS_PER_PARTITION = 2


def packed(values: np.ndarray) -> bytes:
    """A sorted array, byte plane by byte plane, compressed."""
    raw = values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    raw = pa.decompress(blob[8:], decompressed_size=n * 8, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel()


class Words:
    """The word hashes of a group of documents, in chunks of whole documents."""

    def __init__(self, texts: list[str | None]):
        self.raw = [(t or "").encode("utf-8", "replace") for t in texts]

    def chunks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, document of each word, hash of each word)."""
        first = 0
        while first < len(self.raw):
            last, size = first, 0
            while last < len(self.raw) and (last == first or size + len(self.raw[last]) <= CHUNK):
                size += len(self.raw[last]) + 1
                last += 1
            part = self.raw[first:last]
            data = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
            ends = np.cumsum([len(p) + 1 for p in part])
            start, stop = word_spans(data, SPACES)
            yield first, np.searchsorted(ends, start, "right"), word_hashes(data, start, stop)
            first = last


def _windows(owner: np.ndarray, words: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window that lies in one document, and where it starts."""
    keys = window_hashes(words, size, seed)
    at = np.flatnonzero(owner[: len(keys)] == owner[size - 1 :][: len(keys)])
    return at, keys[at]


def _buckets(sorted_keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket of the key space begins in a sorted array."""
    edges = np.array([b * (1 << bits) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]))


class Search:
    """The functions Spark runs on groups and buckets."""

    def __init__(self, window: int, buckets: int):
        self.window, self.buckets = window, buckets
        self.block = (window + 1) // 2

    def _marks(self, doc: np.ndarray) -> np.ndarray:
        """Which words begin a block: every block-th word of its document."""
        first = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1)) if len(doc) else np.zeros(0, np.int64)
        within = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
        return within % self.block == 0

    def probes(self, key, group):
        """For each bucket the keys of all rolling windows; two low bits say: begins a block, occurs twice."""
        found = []
        for _, doc, words in Words(group.column("text").to_pylist()).chunks():
            at, keys = _windows(doc, words, self.block)
            found.append((keys >> np.uint64(8)) << np.uint64(1) | self._marks(doc)[at].astype(np.uint64))
        values = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        bare = values >> np.uint64(1)
        first = np.flatnonzero(np.concatenate(([True], bare[1:] != bare[:-1]))) if len(bare) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(bare)) - 1
        out = (bare[first] << np.uint64(2) | (values[last] & np.uint64(1)) << np.uint64(1) | (last > first).astype(np.uint64)) if len(first) else bare
        cut = _buckets(out, self.buckets, 58)
        return self._sent(key, [out[a:b] for a, b in zip(cut, cut[1:])])

    def _sent(self, key, parts: list[np.ndarray], more: list[list[np.ndarray]] = ()) -> pa.Table:
        use = [b for b, p in enumerate(parts) if len(p)]
        columns = [pa.array([key[0].as_py()] * len(use), pa.int64()), pa.array(use, pa.int64()), pa.array([packed(parts[b]) for b in use], pa.binary())]
        names = ["g", "bucket", "keys"]
        for name, extra in zip(("more", "docs"), more):
            columns.append(pa.array([packed(extra[b]) for b in use], pa.binary()))
            names.append(name)
        return pa.Table.from_arrays(columns, names)

    def met(self, key, bucket):
        """Back to each group those of its keys that begin a block somewhere and occur twice."""
        groups, parts = bucket.column("g").to_pylist(), [unpacked(b) for b in bucket.column("keys").to_pylist()]
        every = np.sort(np.concatenate(parts))
        bare = every >> np.uint64(2)
        first = np.flatnonzero(np.concatenate(([True], bare[1:] != bare[:-1])))
        flags = np.bitwise_or.reduceat(every, first)
        size = np.diff(np.append(first, len(bare)))
        good = bare[first][((flags & np.uint64(2)) > 0) & ((size > 1) | ((flags & np.uint64(1)) > 0))]
        hits = [np.intersect1d(p >> np.uint64(2), good, assume_unique=True) for p in parts]
        use = [i for i, h in enumerate(hits) if len(h)]
        return pa.Table.from_arrays([pa.array([groups[i] for i in use], pa.int64()), pa.array([packed(hits[i]) for i in use], pa.binary())], ["g", "keys"])

    def _candidates(self, doc, words, hits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the windows begin that hold a met block, and their keys."""
        n = len(words) - self.window + 1
        at, keys = _windows(doc, words, self.block)
        place = np.searchsorted(hits, keys := keys >> np.uint64(8))
        met = at[hits[np.minimum(place, len(hits) - 1)] == keys] if len(hits) else at[:0]
        if n <= 0 or not len(met):
            return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        total = np.concatenate(([0], np.cumsum(np.bincount(met, minlength=len(words)))))
        span = self.window - self.block + 1
        start = np.arange(n)
        start = start[(total[start + span] > total[start]) & (doc[start] == doc[start + self.window - 1])]
        return start, window_hashes(words, self.window, 1)[start], window_hashes(words, self.window, 2)[start] >> np.uint64(48)

    @staticmethod
    def _hits(table: pa.Table, column: str = "keys") -> np.ndarray:
        parts = [unpacked(b) for b in table.column(column).to_pylist()]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def extended(self, key, group, met):
        """For each bucket the keys of the windows around met blocks, each with its smallest document here."""
        hits, ids = np.sort(self._hits(met)), group.column("k_id").to_numpy()
        one, two, docs = [], [], []
        for first, doc, words in Words(group.column("text").to_pylist()).chunks():
            start, a, b = self._candidates(doc, words, hits)
            one.append(a), two.append(b), docs.append(ids[first + doc[start]])
        one, two, docs = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, two, docs))
        order = np.lexsort((docs, two, one))
        one, two, docs = one[order], two[order], docs[order]
        new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) if len(one) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(one)) - 1 if len(first) else first
        several = (docs[last] != docs[first]).astype(np.uint64)  # a higher document here repeats a lower one
        one, two, docs = one[first], two[first] << np.uint64(1) | several, (docs[first] ^ NO_ID).view(np.uint64)
        cut = _buckets(one, self.buckets, 64)
        pieces = [[x[a:b] for a, b in zip(cut, cut[1:])] for x in (one, two, docs)]
        return self._sent(key, pieces[0], pieces[1:])

    def smallest(self, key, bucket):
        """Back to each group its keys that a smaller document than one of its own has."""
        groups = bucket.column("g").to_pylist()
        parts = [[unpacked(b) for b in bucket.column(c).to_pylist()] for c in ("keys", "more", "docs")]
        one, two, docs = (np.concatenate(p) for p in parts)
        owner = np.repeat(np.arange(len(groups)), [len(p) for p in parts[0]])
        several, two = two & np.uint64(1), two >> np.uint64(1)
        order = np.lexsort((docs, two, one))
        one, two, docs, owner, several = (x[order] for x in (one, two, docs, owner, several))
        first = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
        least = np.repeat(docs[first], np.diff(np.append(first, len(one))))
        told = np.flatnonzero((least < docs) | (several > 0))
        told = told[np.argsort(owner[told], kind="stable")]
        out: tuple[list, list, list, list] = ([], [], [], [])
        for i in np.unique(owner[told]):
            a, b = np.searchsorted(owner[told], [i, i + 1])
            rows = told[a:b]
            for column, value in zip(out, (groups[i], packed(one[rows]), packed(two[rows]), packed(least[rows]))):
                column.append(value)
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["g", "keys", "more", "docs"]
        )

    def judged(self, key, group, told):
        """Every document of a group with its removed words and what is left."""
        one, two, least = (self._hits(told, c) for c in ("keys", "more", "docs"))
        order = np.lexsort((two, one))
        one, two, least = one[order], two[order], least[order]
        ids = (group.column("k_id").to_numpy() ^ NO_ID).view(np.uint64)
        corpus = Words(group.column("text").to_pylist())
        out: tuple[list, ...] = ([], [], [], [])
        for first, doc, words in corpus.chunks():
            removed = np.zeros(len(words) + 1, np.int64)
            if len(one):
                # told keys hold met blocks, so every window may be looked up
                start, a = _windows(doc, words, self.window, 1)
                b = window_hashes(words, self.window, 2)[start] >> np.uint64(48)
                place = np.searchsorted(one, a)
                while len(start):  # equal first keys lie side by side
                    inside = place < len(one)
                    start, a, b, place = start[inside], a[inside], b[inside], place[inside]
                    same = one[place] == a
                    start, a, b, place = start[same], a[same], b[same], place[same]
                    hit = (two[place] == b) & (least[place] < ids[first + doc[start]])
                    np.add.at(removed, start[hit], 1)
                    np.add.at(removed, start[hit] + self.window, -1)
                    place = place + 1
            gone = np.cumsum(removed)[: len(words)] > 0
            last = int(doc[-1]) + 1 if len(doc) else 0
            edges = np.searchsorted(doc, np.arange(last + 1))
            end = min(len(corpus.raw), first + self._documents(corpus, first))
            for d in range(end - first):
                a, b = (edges[d], edges[d + 1]) if d < last else (0, 0)
                cut = corpus.raw[first + d].split()
                n = int(gone[a:b].sum())
                kept = compress(cut, (~gone[a:b]).tolist()) if n else cut
                for column, value in zip(out, (len(cut), n, hashlib.sha256(b" ".join(kept)).hexdigest(), np.flatnonzero(gone[a:b]).tolist() if n else [])):
                    column.append(value)
        return pa.Table.from_arrays(
            [group.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))))],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"],
        )

    @staticmethod
    def _documents(corpus: Words, first: int) -> int:
        """How many documents the chunk that begins with this one holds."""
        n, size = 0, 0
        while first + n < len(corpus.raw) and (n == 0 or size + len(corpus.raw[first + n]) <= CHUNK):
            size += len(corpus.raw[first + n]) + 1
            n += 1
        return n


def first_occurrences(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, the digest of what is left, and the numbers of the removed words of every row."""
    groups = GROUPS_PER_PARTITION * max(1, docs.rdd.getNumPartitions())
    search = Search(window, groups)
    rows = document_rows(docs, id_col, text_col).withColumn("k_id", F.coalesce("doc_id", F.lit(NO_ID)))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("k_id", "text"), F.lit(groups)))
    by_group = dealt.select("g", "doc_id", "k_id", "text").groupBy("g")
    probes = by_group.applyInArrow(lambda key, t: search.probes(key, t), "g bigint, bucket bigint, keys binary")
    met = probes.groupBy("bucket").applyInArrow(lambda key, t: search.met(key, t), "g bigint, keys binary")
    windows = by_group.cogroup(met.groupBy("g")).applyInArrow(lambda key, t, u: search.extended(key, t, u), "g bigint, bucket bigint, keys binary, more binary, docs binary")
    told = windows.groupBy("bucket").applyInArrow(lambda key, t: search.smallest(key, t), "g bigint, keys binary, more binary, docs binary")
    return by_group.cogroup(told.groupBy("g")).applyInArrow(
        lambda key, t, u: search.judged(key, t, u), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, removed array<int>"
    )
