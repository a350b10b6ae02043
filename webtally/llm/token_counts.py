"""Token counts with a shortcut for pre-tokens that are one token (operator 2).

Which vocabulary strings encode alone as one token is proved before the first text is seen, by merging each of them. A
pre-token found in that table costs one lookup; only the others are merged, once per task and distinct string.

Null and empty texts have no tokens. Rows are independent: repeated rows and ties get equal results, an empty table an
empty result, other columns are ignored. A text of any length is read in pieces between its matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bpe
from .common import document_rows, text_bytes, texts_of

#: How byte-level vocabularies of this kind cut text (fixed value).
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct merged pre-tokens a worker remembers before it starts anew; bounds memory, not results.
REMEMBERED = 300_000
#: Texts beyond this many characters are cut lazily instead of into one list.
LONG_TEXT = 1 << 20


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """The texts that encode alone as one token."""
    merges = bpe.load(path)
    back = {letter: b for b, letter in enumerate(bpe.LETTERS)}
    proved = set()
    for token in merges.vocab:
        if all(c in back for c in token) and merges.merge(merges.symbols(token)) == [token]:
            try:
                proved.add(bytes(back[c] for c in token).decode("utf-8"))
            except UnicodeDecodeError:
                continue  # part of a character: never a pre-token
    return frozenset(proved)


class _Counts(dict):
    """Tokens by pre-token; what is missing is merged."""

    def __init__(self, path: str):
        self.merges, self.proved = bpe.load(path), whole_tokens(path)
        self.older: dict[str, int] = {}  # what was merged before the last new start
        super().__init__(dict.fromkeys(self.proved, 1))

    def __missing__(self, pretoken: str) -> int:
        n = self.older.get(pretoken)
        if n is not None:
            self[pretoken] = n
            return n
        if len(self) > len(self.proved) + REMEMBERED:
            self.older = dict(self)
            self.clear()
            self.update(dict.fromkeys(self.proved, 1))
        n = len(self.merges.merge(self.merges.symbols(bpe.letters(pretoken))))
        if len(pretoken) < 200:
            self[pretoken] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str):
    counts = _Counts(path)
    cut = bpe.Cutter(PRETOKENS)
    special = list(counts.merges.special)
    specials = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count(text: str) -> int:
        total, pieces = 0, [text]
        if specials is not None and any(s in text for s in special):
            pieces = specials.split(text)
            total = len(pieces) - 1
        look = counts.__getitem__
        for piece in pieces:
            if len(piece) <= LONG_TEXT:
                total += sum(map(look, cut.findall(piece)))
            else:
                total += sum(look(m[0]) for m in cut.finditer(piece))
        return total

    return count


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens is over the limit, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            n = pa.array([count(t) for t in texts_of(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = document_rows(docs, id_col, text_col).withColumn("n_bytes", text_bytes(F.col("text")))
    counted = rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
