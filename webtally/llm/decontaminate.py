"""Benchmark passages found by an FM-index over each shard of documents (operator 8).

A shard is some megabytes of text in one task. Its words become numbers if any benchmark item uses them; other words only
separate, so that just the runs of benchmark words that are long enough for a phrase are indexed. Over them stand a suffix
array, its Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions. All phrases are searched backwards
at once through the ranks; their occurrences are located by walking to the next sample, and become spans of words.

Phrases reach the tasks in blocks of a bounded number of words, one pass over the documents for each block.

Null and empty texts have no words; an item without words has no phrase. A null item id counts as an empty one. Rows are
independent, so repeated rows and ties get equal results; empty tables give no hits or no rows; other columns are kept by
``without_passages`` and ignored otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import document_rows, word_hashes, word_spans, written
from .repeats import suffix_ranks
from .simhash import LOWER

#: Characters that end words, as bytes: all of ASCII but digits and letters. (Fixed values.)
NOT_WORD = np.array([c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F for c in range(256)])
#: Text bytes of a shard, benchmark words of a block of phrases, distance of sampled suffix positions.
SHARD = 1 << 20
BLOCK_WORDS = 2_000_000
SAMPLE = 16


def split_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words, A-Z in lower case."""
    codes = np.frombuffer(data.translate(LOWER), np.uint8)
    start, end = word_spans(codes, NOT_WORD)
    return start, end, word_hashes(codes, start, end)


@dataclass
class Phrases:
    """The windows of a block of items: words as numbers from 1, 0 where a phrase is over."""

    vocabulary: np.ndarray
    grid: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], window: int) -> Phrases:
        found: dict[tuple, set[str]] = {}
        for item_id, text in items:
            words = split_words((text or "").encode("utf-8", "replace"))[2].tolist()
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).add(item_id or "")
        vocabulary = np.unique(np.array([w for phrase in found for w in phrase], np.uint64))
        lengths = np.array([len(p) for p in found], np.int64)
        grid = np.zeros((len(found), window), np.int64)
        for row, phrase in enumerate(found):
            grid[row, : len(phrase)] = np.searchsorted(vocabulary, np.array(phrase, np.uint64)) + 1
        return cls(vocabulary, grid, lengths, [sorted(i) for i in found.values()])


class WaveletMatrix:
    """Ranks and accesses over a sequence of numbers, bit by bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = (values >> shift) & 1
            ones = np.concatenate(([0], np.cumsum(bit)))
            self.levels.append((shift, bit, ones, len(values) - int(ones[-1])))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, value: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each value stands before each place."""
        low, high = np.zeros_like(place), place
        for shift, _, ones, zeros in self.levels:
            one = (value >> shift & 1) == 1
            low, high = (np.where(one, zeros + ones[x], x - ones[x]) for x in (low, high))
        return high - low

    def access(self, place: np.ndarray) -> np.ndarray:
        value = np.zeros_like(place)
        for _, bit, ones, zeros in self.levels:
            b = bit[place]
            value = value << 1 | b
            place = np.where(b == 1, zeros + ones[place], place - ones[place])
        return value


class FMIndex:
    """Backward search and location over runs of numbers from 1; nothing matches across runs."""

    def __init__(self, values: np.ndarray, begins: np.ndarray):
        """``begins`` marks where a run begins; each run is followed by one 0 in ``values``."""
        separators = np.flatnonzero(values == 0)
        codes = values + len(separators)
        codes[separators] = np.arange(len(separators))  # separators all differ
        rank = suffix_ranks(codes)
        suffix = np.empty_like(rank)
        suffix[rank] = np.arange(len(rank))
        transform = values[suffix - 1]
        self.bits = max(1, int(values.max()).bit_length())
        self.matrix = WaveletMatrix(transform, self.bits)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(values, minlength=1 << self.bits))))
        self.size = len(values)
        sampled = begins | (np.arange(self.size) % SAMPLE == 0)
        self.sampled = sampled[suffix]
        self.number = np.cumsum(self.sampled) - 1
        self.positions = suffix[self.sampled]

    def search(self, grid: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that begin with each phrase."""
        low, high = np.zeros(len(grid), np.int64), np.full(len(grid), self.size)
        for back in range(int(lengths.max(initial=0))):
            active = np.flatnonzero((lengths > back) & (low < high))
            if not len(active):
                break
            word = grid[active, lengths[active] - 1 - back]
            inside = word < 1 << self.bits
            word = np.where(inside, word, 0)
            for bound in (low, high):
                bound[active] = self.before[word] + self.matrix.rank(word, bound[active])
            high[active[~inside]] = low[active[~inside]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back until a sampled one, which each run begins with at the latest."""
        out, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            done = self.sampled[rows]
            out[open_[done]] = self.positions[self.number[rows[done]]] + steps
            open_, rows = open_[~done], rows[~done]
            value = self.matrix.access(rows)
            rows = self.before[value] + self.matrix.rank(value, rows)
            steps += 1
        return out


class Searcher:
    """Finds a block of phrases in shards."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.near = np.zeros(1 << 16, bool)
        self.near[phrases.vocabulary >> np.uint64(48)] = True

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for words of no phrase."""
        out = np.zeros(len(words), np.int64)
        maybe = np.flatnonzero(self.near[words >> np.uint64(48)])
        vocabulary = self.phrases.vocabulary
        place = np.minimum(np.searchsorted(vocabulary, words[maybe]), len(vocabulary) - 1)
        same = vocabulary[place] == words[maybe]
        out[maybe[same]] = place[same] + 1
        return out

    def find(self, numbers: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of every occurrence; numbers of all words of a shard, with their documents."""
        none = np.zeros(0, np.int64)
        if not len(numbers) or not len(self.phrases.lengths):
            return none, none
        breaks = np.concatenate(([True], (doc[1:] != doc[:-1]) | (numbers[1:] == 0) | (numbers[:-1] == 0)))
        start = np.flatnonzero(breaks)
        length = np.diff(np.append(start, len(numbers)))
        use = (numbers[start] > 0) & (length >= self.phrases.lengths.min())
        start, length = start[use], length[use]
        if not len(start):
            return none, none
        at = np.cumsum(length + 1) - length - 1  # where each run begins in the indexed text
        word = np.repeat(start - at, length + 1) + np.arange(int((length + 1).sum()))
        values = numbers[np.minimum(word, len(numbers) - 1)]
        values[at + length] = 0
        begins = np.zeros(len(values), bool)
        begins[at] = True
        index = FMIndex(values, begins)
        low, high = index.search(self.phrases.grid, self.phrases.lengths)
        count = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return word[index.locate(rows)], phrase

    def shard(self, texts: list[bytes]) -> Iterator[tuple[int, list[int], list[str]]]:
        """For each text its number of words, spans (first word, past last word, from byte, to byte) and items."""
        data = b"\n".join(texts) + b"\n"
        ends = np.cumsum([len(t) + 1 for t in texts])
        start, end, hashes = split_words(data)
        doc = np.searchsorted(ends, start, "right")
        first, phrase = self.find(self.numbers(hashes), doc)
        edge = np.zeros(len(start) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + self.phrases.lengths[phrase], -1)
        hit = np.cumsum(edge)[:-1] > 0
        # a span ends where its document does
        opens = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1] | (doc[1:] != doc[:-1])))) if len(hit) else np.zeros(0, np.int64)
        closes = np.flatnonzero(hit & np.concatenate((~hit[1:] | (doc[1:] != doc[:-1]), [True]))) if len(hit) else opens
        edges = np.searchsorted(doc, np.arange(len(texts) + 1))
        seen = np.unique(np.column_stack([doc[first], phrase]), axis=0)
        span_edges, seen_edges = np.searchsorted(doc[opens], np.arange(len(texts) + 1)), np.searchsorted(seen[:, 0], np.arange(len(texts) + 1))
        for d in range(len(texts)):
            base, words = int(ends[d]) - len(texts[d]) - 1, int(edges[d])
            spans: list[int] = []
            for a, b in zip(opens[span_edges[d] : span_edges[d + 1]], closes[span_edges[d] : span_edges[d + 1]]):
                spans += [int(a) - words, int(b) + 1 - words, int(start[a]) - base, int(end[b]) - base]
            items = {i for p in seen[seen_edges[d] : seen_edges[d + 1], 1] for i in self.phrases.items[p]}
            yield int(edges[d + 1]) - words, spans, sorted(items)


def shards(texts: list[str | None], searcher: Searcher) -> Iterator[tuple[int, list[int], list[str]]]:
    part, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        if part and size + len(raw) > SHARD:
            yield from searcher.shard(part)
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield from searcher.shard(part)


def merged(flat: list[int]) -> list[list[int]]:
    """Spans of several blocks as maximal ones."""
    out: list[list[int]] = []
    for span in sorted(flat[i : i + 4] for i in range(0, len(flat), 4)):
        if out and span[0] <= out[-1][1]:
            if span[1] > out[-1][1]:
                out[-1][1], out[-1][3] = span[1], span[3]
        else:
            out.append(span)
    return out


def blocks_of_phrases(benchmark: DataFrame, window: int) -> Iterator[Phrases]:
    """The phrases of all items, in blocks of a bounded number of words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    # every second byte of a text can be a word at most
    words = items.agg(F.sum(F.ceil(F.octet_length("text") / 2))).first()[0] or 0
    blocks = -(-words // BLOCK_WORDS)
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct()
        yield Phrases.of([(r["item_id"], r["text"]) for r in part.toLocalIterator()], window)


def _searched(rows: DataFrame, benchmark: DataFrame, window: int, text_col: str, finish, schema: str) -> DataFrame:
    """``finish(batch, words, spans, items)`` of every batch, after one pass for each block of phrases.

    What one block finds goes to the next with the rows; the last pass finishes them.
    """
    none = Phrases(np.zeros(0, np.uint64), np.zeros((0, window), np.int64), np.zeros(0, np.int64), [])
    n_columns, longest = len(rows.columns), max(rows.columns, key=len)
    more_names = (f"{longest}_spans", f"{longest}_items")  # of no column here
    for last, phrases in _numbered(blocks_of_phrases(benchmark, window), none):
        carried = len(rows.columns) > n_columns

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases, last=last, carried=carried) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(phrases)
            for batch in batches:
                found = list(shards(batch.column(text_col).to_pylist(), searcher))
                words, spans, items = ([f[i] for f in found] for i in range(3))
                if carried:
                    spans = [a + b for a, b in zip(batch.column(n_columns).to_pylist(), spans)]
                    items = [a + b for a, b in zip(batch.column(n_columns + 1).to_pylist(), items)]
                    batch = batch.select(list(range(n_columns)))
                if last:
                    yield finish(batch, words, spans, items)
                else:
                    more = [pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *more_names])

        wider = rows if carried else rows.withColumns({more_names[0]: F.array().cast("array<bigint>"), more_names[1]: F.array().cast("array<string>")})
        rows = rows.mapInArrow(run, schema) if last else written(rows.mapInArrow(run, wider.schema), "searched")
    return rows


def _numbered(blocks: Iterator[Phrases], none: Phrases) -> Iterator[tuple[bool, Phrases]]:
    """Whether it is the last, and each block; the driver holds two at most."""
    before = next(blocks, none)
    while before is not None:
        after = next(blocks, None)
        yield after is None, before
        before = after


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, digest of the items, contaminated, and the spans of every row."""

    def finish(batch: pa.RecordBatch, words: list, spans: list, items: list) -> pa.RecordBatch:
        spans, items = [merged(x) for x in spans], [sorted(set(x)) for x in items]
        hit = [sum(b - a for a, b, _, _ in x) for x in spans]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        columns = {
            "n_words": (words, pa.int64()), "n_hit": (hit, pa.int64()), "n_items": ([len(x) for x in items], pa.int64()),
            "items_sha256": (digest, pa.string()), "contaminated": ([h > 0 for h in hit], pa.bool_()),
            "spans": ([[x for span in s for x in span] for s in spans], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in columns.values())], ["doc_id", *columns])

    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<bigint>"
    return _searched(document_rows(docs, id_col, text_col), benchmark, window, "text", finish, schema)


def without_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """The rows with all their columns; benchmark passages are cut out of their texts."""
    at = docs.columns.index(text_col)

    def finish(batch: pa.RecordBatch, words: list, spans: list, items: list) -> pa.RecordBatch:
        texts = []
        for text, found in zip(batch.column(at).to_pylist(), spans):
            if found:
                raw, kept, last = text.encode("utf-8", "replace"), [], 0
                for _, _, a, b in merged(found):
                    kept.append(raw[last:a])
                    last = b
                text = b"".join([*kept, raw[last:]]).decode("utf-8", "replace")
            texts.append(text)
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return _searched(docs, benchmark, window, text_col, finish, docs.schema)
