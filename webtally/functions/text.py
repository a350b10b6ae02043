"""Column helpers for text, line and match arrays."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .dialect import WHITESPACE


def constant(rows: Sequence, ddl: str) -> Column:
    """A constant array column from plain Python values; folded once when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(rows)), ddl)


def strings(values: Sequence[str]) -> Column:
    return constant(list(values), "array<string>")


def split_lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def cut(text: Column, chars: int | None, mark: str = "") -> Column:
    """The first ``chars`` characters, followed by ``mark`` where some are left out; ``None`` keeps all."""
    if chars is None:
        return text
    start = F.substring(text, 1, chars)
    return F.when(F.length(text) > chars, F.concat(start, F.lit(mark))).otherwise(text) if mark else start


def extract_all(text: Column, java_pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern), F.lit(group))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used inside a lambda would be inlined there by the optimizer and
    computed again for every element; bound as a lambda argument it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_by_key(structs: Column, keys: Sequence[str]) -> Column:
    """Keep the first struct per key in an array, without a shuffle.

    The struct must start with the key fields, followed by the order fields:
    after sorting, the first of each key is the one whose predecessor differs.
    """

    def pick(ordered: Column) -> Column:
        def is_first(x: Column, i: Column) -> Column:
            before = F.get(ordered, i - 1)
            differs = i == 0
            for key in keys:
                differs = differs | ~before.getField(key).eqNullSafe(x.getField(key))
            return differs

        return F.filter(ordered, is_first)

    return let(F.sort_array(structs), pick)


def reshape(structs: Column, *fields: str) -> Column:
    """The same array with only the given struct fields, in that order."""
    return F.transform(structs, lambda s: F.struct(*[s.getField(f).alias(f) for f in fields]))


def explode_structs(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per struct with its fields as columns.

    The outer form plus a filter keeps Catalyst from inferring ``size > 0`` and
    evaluating the array a second time below the generator.
    """
    rows = df.select(*keep, F.explode_outer(column).alias("_s")).where(F.col("_s").isNotNull())
    return rows.select(*keep, "_s.*")
