"""Version comparison by the first three numeric parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def version_key(version: Column) -> Column:
    """Numeric parts as an array; NULL if one of the first three is no number."""
    bare = F.regexp_replace(version, r"^[v^~>=<]", "")
    bare = F.split(F.split(bare, "-", -1)[0], r"\+", -1)[0]
    parts = F.transform(F.slice(F.split(bare, r"\.", -1), 1, 3), lambda p: p.try_cast("bigint"))
    return F.when(~F.exists(parts, lambda p: p.isNull()), parts)


def version_below(version: Column, threshold: Column) -> Column:
    """True if ``version`` sorts before ``threshold``; a shorter equal prefix sorts first."""
    return F.coalesce(version_key(version) < version_key(threshold), F.lit(False))
