"""Match a list of patterns against the lines of a file, inside its row.

The pattern list is a constant array, and the loop order is pattern, then line:
a pattern is compiled once per file and only if one of its anchors occurs in the
text. The plan has the same size for one pattern and for a thousand, nothing is
joined or shuffled, and it runs unchanged on a stream.

``first_matches`` does the same for long lists, such as the signature rules, in an
Arrow function: there a pattern is compiled once per worker and not once per file.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from . import dialect
from .text import constant, let, split_lines

_TYPE = "array<struct<id: int, rx: string, g: array<int>, anchors: array<array<string>>>>"


class LinePattern(NamedTuple):
    """A pattern, the groups to return, and literals it needs (one of each list);
    ``run`` is the character class of an unlimited repeat it starts with, ``first``
    what the only match in a line starts with."""

    pattern: str
    groups: tuple[int, ...] = (1,)
    anchors: tuple[tuple[str, ...], ...] = ()
    ignore_case: bool = False
    run: str = ""
    first: str = ""


def _pattern_array(patterns: Sequence[LinePattern]) -> Column:
    rows = [
        {
            "id": i,
            "rx": dialect.java(p.pattern, p.ignore_case, p.run, p.first),
            "g": list(p.groups),
            "anchors": [list(a) for a in p.anchors],
        }
        for i, p in enumerate(patterns, 1)
    ]
    return constant(rows, _TYPE)


def _has_anchors(p: Column, text: Column) -> Column:
    return F.forall(p.getField("anchors"), lambda group: F.exists(group, lambda anchor: F.contains(text, anchor)))


def active_patterns(patterns: Sequence[LinePattern], searched: Column) -> Column:
    """The patterns whose anchors occur in ``searched``."""
    return let(searched, lambda text: F.filter(_pattern_array(patterns), lambda p: _has_anchors(p, text)))


def pattern_matches(active: Column, lines: Column, n_groups: int, searched: Column | None = None) -> Column:
    """``array<struct<id, line, pos, g1 … gn>>`` in the order pattern, line, position.

    ``lines`` must be a column or lambda argument, so that it is computed once. So must ``searched``: for each line the
    text in which anchors are looked up before the line is matched, NULL to match it anyway. A match never leaves its line.
    """
    none = F.array().cast("array<string>")

    def on_pattern(p: Column) -> Column:
        rx, groups = p.getField("rx"), p.getField("g")

        def on_line(line: Column, i: Column) -> Column:
            tried = None if searched is None else F.coalesce(_has_anchors(p, F.get(searched, i)), F.lit(True))

            def group(k: int) -> Column:
                found = F.regexp_extract_all(line, rx, F.get(groups, F.lit(k)))
                return found if tried is None else F.when(tried, found).otherwise(none)

            def build(values: list[Column], pos: Column) -> Column:
                fields = [v.alias(f"g{k + 1}") for k, v in enumerate(values)]
                return F.struct(p.getField("id").alias("id"), (i + 1).alias("line"), pos.alias("pos"), *fields)

            if n_groups == 1:
                return F.transform(group(0), lambda m, pos: build([m], pos))
            columns = [group(0)] + [
                F.when(F.size(groups) > k, group(k)).otherwise(none) for k in range(1, n_groups)
            ]
            return F.transform(
                F.arrays_zip(*columns),
                lambda m, pos: build([F.nullif(m.getField(str(k)), F.lit("")) for k in range(n_groups)], pos),
            )

        return F.flatten(F.transform(lines, on_line))

    return F.flatten(F.transform(active, on_pattern))


def anchored_matches(patterns: Sequence[LinePattern], content: Column, n_groups: int) -> Column:
    """The matches in the lines of ``content``: anchors are looked up in the lower-cased text, then in its lines.

    Letters that equal an ASCII letter when case is ignored hide anchors: all lines of a text with such letters are matched
    once a pattern is active.
    """

    def find(t: Column) -> Column:
        text, odd = t.getField("text"), t.getField("odd")
        searched = F.when(~odd, split_lines(text)).alias("searched")
        active = active_patterns(patterns, text).alias("active")
        return let(
            F.struct(active, split_lines(t.getField("content")).alias("lines"), searched),
            lambda p: pattern_matches(p.getField("active"), p.getField("lines"), n_groups, p.getField("searched")),
        )

    folded = F.struct(content.alias("content"), F.lower(content).alias("text"), content.rlike(dialect.CASE_VARIANTS).alias("odd"))
    return let(folded, find)


_ODD = re.compile(dialect.CASE_VARIANTS)
_MATCHES = pa.struct([("id", pa.int32()), ("line", pa.int32()), ("pos", pa.int32()), ("g1", pa.string())])
#: Characters of texts whose lines are searched together.
_TOGETHER = 1 << 20


def _find(line: str, rx: re.Pattern, at_run: re.Pattern | None) -> Iterator[re.Match]:
    """All matches in a line; with ``at_run`` only at the start of a run and at the end of the previous match."""
    if at_run is None:
        yield from rx.finditer(line)
        return
    m = at_run.search(line)
    while m:
        yield m
        m = rx.match(line, m.end()) or at_run.search(line, m.end())


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    chunk, size = [], 0
    for text in texts:
        chunk.append(text.as_py() or "")
        size += len(chunk[-1])
        if size >= _TOGETHER:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def first_matches(patterns: Sequence[LinePattern], key_chars: int | None = None) -> Callable[[Column], Column]:
    """The matches in the lines of a text as ``array<struct<id, line, pos, g1>>`` in the order pattern, line, position;
    of those of a pattern that begin with the same ``key_chars`` characters the first one only.

    Anchors are looked up in the lower-cased lines of many texts at once. Letters that equal an ASCII letter when case is
    ignored may hide them: all patterns are tried on a line with such letters.
    """
    compiled = []
    for p in patterns:
        flags = re.IGNORECASE if p.ignore_case else 0
        rx = re.compile((f"^(?>.*?(?={p.first}))" if p.first else "") + p.pattern, flags)
        compiled.append((rx, re.compile(f"(?<!{p.run}){p.pattern}", flags) if p.run else None))

    def search(texts: list[str]) -> pa.Array:
        joined = "\n".join(texts)
        lines, lowered = joined.split("\n"), joined.lower()
        text_of = [t for t, text in enumerate(texts) for _ in range(text.count("\n") + 1)]
        ends = [*accumulate(len(line) + 1 for line in lowered.split("\n"))]
        odd = {k for k, line in enumerate(lines) if _ODD.search(line)} if _ODD.search(joined) else set()

        @functools.cache
        def having(anchor: str) -> set[int]:
            found, at = set(), lowered.find(anchor)
            while at >= 0:
                k = bisect_right(ends, at)
                found.add(k)
                at = lowered.find(anchor, ends[k])
            return found

        rows = []
        for i, (p, (rx, at_run)) in enumerate(zip(patterns, compiled, strict=True), 1):
            groups = [set().union(*map(having, group)) for group in p.anchors]
            seen = set()
            for k in sorted(set.intersection(*groups) | odd) if groups else range(len(lines)):
                for pos, m in enumerate(_find(lines[k], rx, at_run)):
                    value = m[1] or ""
                    key = (text_of[k], value[:key_chars])
                    if key not in seen:
                        seen.add(key)
                        rows.append((text_of[k], i, k, pos, value))
        rows.sort(key=itemgetter(0))  # found by pattern, returned by text
        of, ids, at, positions, values = zip(*rows, strict=True) if rows else [()] * 5
        starts = np.searchsorted(np.array(text_of), np.arange(len(texts)))
        numbers = np.array(at, "int32") - starts[np.array(of, "int64")] + 1
        columns = [pa.array(c, f.type) for c, f in zip((ids, numbers, positions, values), _MATCHES, strict=True)]
        offsets = np.searchsorted(np.array(of), np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_MATCHES)))

    @F.arrow_udf("array<struct<id: int, line: int, pos: int, g1: string>>")
    def matches(texts: pa.Array) -> pa.Array:
        found = [search(chunk) for chunk in _chunks(texts)]
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(_MATCHES))

    return matches
