"""BPE encoding and decoding over a trie of distinct words (operator 9).

The encoding of a prefix is known from its last token: it is the vocabulary entry that ends the prefix and follows the
last token of what stands before it exactly as merging the two together would leave them. A worker sorts the words it has
not met yet, which is the order of a depth-first walk through their trie, and keeps the states of the path it stands on;
a prefix that words share is encoded once. A word's own encoding is read backwards through the last tokens.

Null and empty texts have no tokens and decode to an empty text. Rows are independent: repeated rows and ties get equal
results, an empty table an empty result, other columns are ignored. Words of any length take time in proportion.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import document_rows, texts_of

#: How this vocabulary cuts normalised text (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Distinct words and token pairs a worker remembers before it starts anew; bounds memory, not results.
REMEMBERED = 150_000
#: Words cut before their distinct forms are encoded together.
HELD_WORDS = 200_000


class PrefixEncoder:
    """Encodes distinct words by walking their trie."""

    def __init__(self, path: str):
        self.merges = bpe.load(path)
        #: The longest entry that ends in these two letters: how far back a last token can start.
        self.reach: dict[str, int] = {}
        for token in self.merges.vocab:
            body = token.removesuffix(self.merges.suffix) if self.merges.suffix and token != self.merges.suffix else token
            tail = body[-2:] + token[len(body) :]
            self.reach[tail] = max(self.reach.get(tail, 1), len(body))
        self.whole = {t for t in self.merges.vocab if self.merges.merge(self._symbols(t)) == [t]}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _symbols(self, token: str) -> list[str]:
        suffix = self.merges.suffix
        if suffix and token.endswith(suffix) and len(token) > len(suffix):
            return self.merges.symbols(token[: -len(suffix)])
        return list(token)

    def _follows(self, before: str, token: str) -> bool:
        """Whether merging the two together leaves them as they are."""
        if len(self.pairs) > 2 * REMEMBERED:
            self.pairs.clear()
        merged = self.merges.merge(self._symbols(before) + self._symbols(token))
        self.pairs[(before, token)] = answer = merged == [before, token]
        return answer

    def _last(self, word: str, end: int, states: list[tuple[str, int]], suffix: str) -> tuple[str, int]:
        """The last token of word[:end] and where it starts; ``suffix`` marks the end of the word."""
        whole, pairs = self.whole, self.pairs
        for start in range(max(0, end - self.reach.get(word[max(0, end - 2) : end] + suffix, 1)), end):
            token = word[start:end] + suffix
            if token in whole:
                if start == 0:
                    return token, 0
                before = states[start][0]
                follows = pairs.get((before, token))
                if self._follows(before, token) if follows is None else follows:
                    return token, start
        return word[end - 1 : end] + suffix, end - 1

    def encode(self, words: list[str]) -> Iterator[list[str]]:
        """The tokens of each word (in byte letters, sorted)."""
        states: list[tuple[str, int]] = [("", 0)]
        path = ""
        for word in words:
            shared, most = 0, min(len(path), len(word) - 1)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word)):
                states.append(self._last(word, end, states, ""))
            path = word[:-1]
            token, start = self._last(word, len(word), states, self.merges.suffix)
            tokens = [token]
            while start > 0:
                token, start = states[start]
                tokens.append(token)
            tokens.reverse()
            yield tokens


class Codec:
    """Encodes and decodes texts; remembers the words it has met."""

    def __init__(self, path: str):
        self.encoder = PrefixEncoder(path)
        self.merges = self.encoder.merges
        self.vocab = {**self.merges.vocab, **self.merges.special}
        self.cut = bpe.Cutter(WORDS)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        #: Word to (ids, tokens), in two generations: what is used stays, what is not goes.
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text; special tokens stand between them as they are."""
        pieces = [text]
        if self.special is not None and any(s in text for s in self.merges.special):
            pieces = self.special.split(text)
        out: list[str] = []
        for i, piece in enumerate(pieces):
            if i % 2:
                out.append(piece)
            else:
                if not piece.isascii():
                    piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
                out += self.cut.findall(piece.lower())
        return out

    def learn(self, words: set[str]) -> None:
        """Make every one of the words known; those not met yet are encoded in trie order."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older, spelled = self.known, self.older, {}
        for word in words.difference(known):
            if word in older:
                known[word] = older[word]
            elif word in self.merges.special:
                known[word] = str(self.merges.special[word]), word
            else:
                spelled[bpe.letters(word)] = word
        vocab, ordered = self.vocab, sorted(spelled)
        for key, tokens in zip(ordered, self.encoder.encode(ordered)):
            known[spelled[key]] = " ".join([str(vocab[t]) for t in tokens]), " ".join(tokens)

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids and its decoding, each joined by blanks."""
        cut: list[list[str]] = []
        held = 0
        for text in texts:
            cut.append(self.words(text))
            held += len(cut[-1])
            if held > HELD_WORDS:
                yield from self._encode(cut)
                cut, held = [], 0
        yield from self._encode(cut)

    def _encode(self, cut: list[list[str]]) -> Iterator[tuple[str, str]]:
        self.learn(set().union(*cut))
        look = self.known.__getitem__
        for words in cut:
            pairs = [look(w) for w in words]
            yield " ".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the token ids as an array, and the decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            pairs = list(c.encode(texts_of(batch)))
            ids = [[int(x) for x in p[0].split()] for p in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return document_rows(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, without shipping either out of the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for ids, decoded in c.encode(texts_of(batch)):
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return document_rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
