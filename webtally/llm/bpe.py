"""Byte-pair merges as a tokenizer file states them, for the token operators."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import regex


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the code points from 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(hidden)) for b in range(256)]


LETTERS = byte_letters()
#: Latin-1 text (one character per byte) to byte letters.
TO_LETTERS = {b: letter for b, letter in enumerate(LETTERS)}


def letters(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(TO_LETTERS)


class Merges:
    """The merge table of one tokenizer file and the plain merging procedure."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, merge in enumerate(model["merges"]):
            self.ranks.setdefault(tuple(merge if isinstance(merge, list) else merge.split(" ")), rank)

    def symbols(self, word: str) -> list[str]:
        """A word in byte letters as the symbols merging starts from."""
        out = list(word)
        if out:
            out[-1] += self.suffix
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        ranks = self.ranks
        if len(symbols) > 48:
            return self._merge_long(symbols)
        out, none = list(symbols), 1 << 60
        look = ranks.get
        order = [look(pair, none) for pair in zip(out, out[1:])]
        while order:
            best = min(order)
            if best == none:
                break
            i = order.index(best)
            out[i : i + 2] = [out[i] + out[i + 1]]
            del order[i]
            if i:
                order[i - 1] = look((out[i - 1], out[i]), none)
            if i < len(order):
                order[i] = look((out[i], out[i + 1]), none)
        return out

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap, for words of any length."""
        ranks, sym, n = self.ranks, list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if sym[i] is not None else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], sym[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if left >= 0 and right < n and (r := ranks.get((sym[left], sym[right]))) is not None:
                    heapq.heappush(heap, (r, left, sym[left], sym[right]))
        return [s for s in sym if s is not None]


@lru_cache(maxsize=4)
def load(path: str) -> Merges:
    return Merges(path)


#: Texts of other characters are cut with full Unicode classes. Within these (Basic Latin to Latin Extended-B, without the
#: information separators and the superscript and fraction numbers) Python's \\w, \\d and \\s say the same, and are faster.
_OTHER = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")


class Cutter:
    """A pattern of \\p{L}, \\p{N} and \\s that finds all its matches in a text."""

    def __init__(self, pattern: str):
        fast = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self._fast, self._full = re.compile(fast), regex.compile(pattern)

    def of(self, text: str):
        return self._full if _OTHER.search(text) else self._fast

    def findall(self, text: str) -> list[str]:
        return self.of(text).findall(text)

    def finditer(self, text: str):
        return self.of(text).finditer(text)
