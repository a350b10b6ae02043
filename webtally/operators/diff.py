"""Compare two scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import SEVERITIES, severity_rank
from .findings import finding_key

KEY = ["k_description", "k_source_url", "k_evidence"]


def keyed_findings(findings: DataFrame, key_chars: int | None = None) -> DataFrame:
    """One finding per key; of several, the last in report order counts.

    ``key_chars`` compares only so many characters of the evidence.
    """
    return _keyed(findings, key_chars).drop("k_hash")


def _keyed(findings: DataFrame, key_chars: int | None) -> DataFrame:
    """The same with a hash of the key before it: rows are sorted by a number, texts are compared where it is equal.

    ``max`` aggregates per task before the shuffle, so copies of one finding
    do not pile up in one place. Texts of the key are sorted once: the finding
    takes them from there, with a mark where a value is missing.
    """
    whole = {"description": "k_description", "source_url": "k_source_url", **({"evidence": "k_evidence"} if key_chars is None else {})}
    fields = [c for c in ("severity", "category", "description", "evidence", "source_url", "line_number", "detector") if c in findings.columns]
    kept = F.struct(
        severity_rank(F.col("severity")).alias("_rank"),
        *[F.coalesce(c, F.lit(0)).alias("_line") for c in ("line_number",) if c in findings.columns],
        # the evidence as it is where the key has only its start
        *[F.coalesce("evidence", F.lit("")).alias("_evidence") for _ in range(key_chars is not None)],
        *[(F.col(c).isNull() if c in whole or c == "evidence" else F.col(c)).alias(c) for c in fields],
    )
    rows = findings.select(*finding_key(key_chars), kept.alias("k"))
    last = rows.groupBy(F.xxhash64(*KEY).alias("k_hash"), *KEY).agg(F.max("k").alias("k"))

    def value(c: str) -> Column:
        if c not in whole and c != "evidence":
            return F.col(f"k.{c}")
        return F.when(~F.col(f"k.{c}"), F.col(whole[c]) if c in whole else F.col("k._evidence"))

    return last.select("k_hash", *KEY, F.struct(*[value(c).alias(c) for c in fields]).alias("f"))


def diff_findings(old: DataFrame, new: DataFrame, key_chars: int | None = None) -> DataFrame:
    """One row per key with status new, resolved, changed or unchanged.

    Both sides have one row per key, so a single full outer join gives all parts.
    """
    before = _keyed(old, key_chars).withColumnRenamed("f", "old")
    after = _keyed(new, key_chars).withColumnRenamed("f", "new")
    joined = before.join(after, ["k_hash", *KEY], "full_outer")
    old_severity = F.coalesce(F.col("old.severity"), F.lit(""))
    new_severity = F.coalesce(F.col("new.severity"), F.lit(""))
    status = (
        F.when(F.col("old").isNull(), "new")
        .when(F.col("new").isNull(), "resolved")
        .when(old_severity != new_severity, "changed")
        .otherwise("unchanged")
    )
    finding = F.coalesce("new", "old")
    return joined.select(
        status.alias("status"),
        F.col("old.severity").alias("old_severity"),
        F.col("new.severity").alias("new_severity"),
        finding.getField("description").alias("description"),
        finding.getField("source_url").alias("source_url"),
        finding.getField("evidence").alias("evidence"),
        severity_rank(finding.getField("severity")).alias("severity_rank"),
    )


def ranked_diff(diff: DataFrame) -> DataFrame:
    """Worst severity first within new and resolved findings (X11)."""
    return diff.where(F.col("status").isin("new", "resolved", "changed")).orderBy(
        "status", "severity_rank", "source_url", "description", "evidence"
    )


def diff_sets(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys added and removed: endpoints, files, (name, version) of dependencies."""
    none, one = F.lit(0), F.lit(1)
    both = old.select(*keys, one.alias("_old"), none.alias("_new")).unionByName(
        new.select(*keys, none.alias("_old"), one.alias("_new"))
    )
    sides = both.groupBy(*keys).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    change = F.when(F.col("_old") == 0, "added").otherwise("removed")
    return sides.where(F.col("_old") != F.col("_new")).select(*keys, change.alias("change"))


def diff_counts(old_counts: DataFrame, new_counts: DataFrame) -> DataFrame:
    """Known severities whose count changed (X8). Input: ``severity, n``."""
    joined = old_counts.withColumnRenamed("n", "_old").join(
        new_counts.withColumnRenamed("n", "_new"), "severity", "full_outer"
    )
    before, after = F.coalesce("_old", F.lit(0)), F.coalesce("_new", F.lit(0))
    return joined.where(F.col("severity").isin(SEVERITIES) & (before != after)).select(
        "severity", before.alias("old"), after.alias("new"), (after - before).alias("delta")
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """How many findings are new, resolved and changed."""

    def count(status: str):
        return F.count(F.when(F.col("status") == status, 1))

    return diff.agg(
        count("new").alias("new_findings"), count("resolved").alias("resolved_findings"),
        count("changed").alias("changed_severity"),
    )


def diff_headers(old_totals: DataFrame, new_totals: DataFrame) -> DataFrame:
    """Totals of both scans side by side (X9). Input: one row each."""
    return old_totals.withColumn("scan", F.lit("old")).unionByName(new_totals.withColumn("scan", F.lit("new")))
