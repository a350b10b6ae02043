"""Toxicity by a weighted lexicon (operator 10).

Text is folded first: lower case, look-alike letters to the Latin letter they imitate, digits and signs that stand for
letters to those letters. One Aho-Corasick automaton finds all lexicon entries in a single walk; an entry counts where it
begins a word. Its weight is added unless one of the exception phrases covers it, the sum is divided by the logarithm of
the text's length, and a logistic curve turns that into a score from 0 to 1.

Lexicon, weights, exception phrases and curve are learned from labelled rows. At most ``SAMPLE_ROWS`` of them are used,
those with the smallest hash of their id; what a worker receives is bounded by ``ENTRIES`` and ``PHRASES``.

Null and empty texts get the score of a text without entries. Rows are independent: repeated rows and ties get equal
scores, other columns are ignored. Without labelled rows, or without both classes, every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import document_rows, texts_of, written

#: Most labelled rows that are learned from.
SAMPLE_ROWS = 20_000
#: Most lexicon entries considered, and most exception phrases.
ENTRIES = 20_000
#: Keys a task counts before it sends them on.
HELD_KEYS = 200_000
PHRASES = 1_000
#: Share of the toxic rows an entry must occur in, and share of toxic rows among those it occurs in.
SUPPORT, PRECISION = 0.015, 0.8
#: Lengths of the word beginnings that are tried as entries.
LENGTHS = range(4, 13)

# Letters of other scripts and their Latin look-alikes, then digits and signs used as letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t",
    "в": "b", "н": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t",
    "υ": "u", "χ": "x", "ϲ": "c", "ı": "i", "ℓ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Full-width letters fold to plain ones by rule; zero-width characters vanish.
_FOLD = str.maketrans(
    LOOKALIKES | SUBSTITUTES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {"​": None, "‌": None, "‍": None, "­": None, "﻿": None}
)
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def features(text: str) -> set[str]:
    """Beginnings of the words of a folded text, and whole words (ending in ``$``)."""
    out = set()
    for word in set(_WORD.findall(text)):
        out.update(word[:k] for k in LENGTHS if k <= len(word))
        if len(word) > 1:
            out.add(word + "$")
    return out


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    #: Of the logistic curve; None: nothing was learned.
    curve: tuple[float, float] | None = None


class Matcher:
    """Finds the entries of a lexicon in folded texts."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            bare = entry.removesuffix("$")
            self.automaton.add_word(bare, (*self.automaton.get(bare, ()), (len(bare), entry != bare, weight)))
        if lexicon.weights:
            self.automaton.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[str, str, str, float]]:
        """Word before, word hit, word after, and weight, for every entry that begins a word."""
        if not self.lexicon.weights:
            return
        for end, found in self.automaton.iter(text):
            for length, whole, weight in found:
                start = end + 1 - length
                if start and text[start - 1].isalpha():
                    continue
                stop = end + 1
                while stop < len(text) and text[stop].isalpha():
                    stop += 1
                if whole and stop != end + 1:
                    continue
                before = _WORD.findall(text[max(0, start - 40) : start])
                after = _WORD.search(text, stop, stop + 40)
                yield before[-1] if before else "", text[start:stop], after[0] if after else "", weight

    def value(self, text: str) -> float:
        """The sum of the weights of all entries outside exception phrases, normalised by length."""
        text, skip = fold(text), self.lexicon.exceptions
        total = sum(w for a, hit, b, w in self.hits(text) if not skip or (f"{a} {hit}" not in skip and f"{hit} {b}" not in skip))
        return total / math.log(math.e + text.count(" ") + text.count("\n")) if total else 0.0

    def score(self, text: str) -> float:
        if self.lexicon.curve is None:
            return 0.0
        a, b = self.lexicon.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * self.value(text)))))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(sample: DataFrame, keys_of) -> DataFrame:
    """Toxic and clean rows by key, summed within each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def told() -> Iterator[pa.RecordBatch]:
            keys = list(counts[1].keys() | counts[0].keys())
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_pydict(
                    {"key": part, "toxic_rows": [counts[1][k] for k in part], "clean_rows": [counts[0][k] for k in part]},
                    pa.schema([("key", pa.string()), ("toxic_rows", pa.int64()), ("clean_rows", pa.int64())]),
                )
            counts[0].clear(), counts[1].clear()

        for batch in batches:
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist()):
                counts[toxic].update(keys_of(fold(text)))
                if len(counts[0]) + len(counts[1]) > HELD_KEYS:
                    yield from told()
        yield from told()

    counted = sample.select("text", "toxic").mapInArrow(run, "key string, toxic_rows bigint, clean_rows bigint")
    return counted.groupBy("key").agg(F.sum("toxic_rows").alias("toxic_rows"), F.sum("clean_rows").alias("clean_rows"))


def _chosen(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries without their own beginnings and endings: of a chain with like support the longest."""
    good = {k: (t, c) for k, t, c in rows if t >= PRECISION * (t + c)}
    weights: dict[str, float] = {}
    for key in sorted(good, key=lambda k: (-good[k][0], k.endswith("$"), -len(k), k)):
        bare = key.removesuffix("$")
        if any(bare[:k] in weights for k in range(1, len(bare) + 1)) or any(w.removesuffix("$").startswith(bare) for w in weights):
            continue
        longest = max((k for k in good if k[-1] != "$" and k.startswith(bare) and good[k][0] >= 0.95 * good[key][0]), key=len, default=key)
        if any(longest[:k] in weights for k in range(1, len(longest) + 1)):
            continue
        t, c = good[longest]
        weights[longest] = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
    return weights


def _fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one value, by Newton's method with a small ridge."""
    design = np.column_stack([np.ones_like(x), x])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - 1e-2 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Learn from the labelled rows that are not held out."""
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    )
    rows = document_rows(docs, id_col, text_col)
    sample = written(rows.join(F.broadcast(known), "doc_id").select("text", "toxic"), "toxicity-sample")  # at most SAMPLE_ROWS ids
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon()
    least = max(5, math.ceil(SUPPORT * toxic))
    tried = _counted(sample.filter("toxic = 1"), features).filter(F.col("toxic_rows") >= least).orderBy(F.desc("toxic_rows"), "key").limit(ENTRIES)
    wanted = frozenset(r["key"] for r in tried.collect())
    counts = _counted(sample, lambda text: features(text) & wanted)
    weights = _chosen([tuple(r) for r in counts.collect()], toxic, clean)
    matcher = Matcher(Lexicon(weights))

    def phrases(text: str) -> set[str]:
        found = set()
        for before, hit, after, _ in matcher.hits(text):
            found.update(p for p, other in ((f"{before} {hit}", before), (f"{hit} {after}", after)) if other)
        return found

    innocent = _counted(sample, phrases).filter((F.col("clean_rows") >= 5) & (F.col("toxic_rows") <= 0.2 * F.col("clean_rows")))
    exceptions = frozenset(r["key"] for r in innocent.orderBy(F.desc("clean_rows"), "key").limit(PHRASES).collect())
    lexicon = Lexicon(weights, exceptions)
    matcher = Matcher(lexicon)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([matcher.value(t) for t in texts_of(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([x, batch.column("toxic")], ["value", "toxic"])

    seen = sample.mapInArrow(values, "value double, toxic int").collect()  # at most a number for each sampled row
    return Lexicon(weights, exceptions, _fitted(np.array([r["value"] for r in seen]), np.array([float(r["toxic"]) for r in seen])))


def score_texts(docs: DataFrame, lexicon: Lexicon, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            score = pa.array([matcher.score(t) for t in texts_of(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score], ["doc_id", "score"])

    scored = document_rows(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted")
    )


def toxic_filter(docs: DataFrame, lexicon: Lexicon, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows that are not toxic, with all their columns."""

    @F.pandas_udf("double")
    def score(texts):
        matcher = _matcher(lexicon_key)
        return texts.map(lambda t: matcher.score(t or ""))

    lexicon_key = _Key(lexicon)
    return docs.filter(score(F.col(text_col)) < F.lit(threshold))


class _Key:
    """A lexicon that a worker builds its matcher from once."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def _id(self):
        return (tuple(self.lexicon.weights.items()), self.lexicon.exceptions, self.lexicon.curve)

    def __hash__(self):
        return hash(self._id())

    def __eq__(self, other):
        return self._id() == other._id()


@lru_cache(maxsize=2)
def _matcher(key: _Key) -> Matcher:
    return Matcher(key.lexicon)
