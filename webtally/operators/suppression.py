"""False-positive suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EVERY_TARGET = "*"


def fingerprint(evidence: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the evidence (F1)."""
    return F.substring(F.sha2(F.coalesce(evidence, F.lit("")), 256), 1, 32)


def _listed(findings: DataFrame, false_positives: DataFrame, how: str) -> DataFrame:
    # one row per key keeps the list small; Catalyst broadcasts it if its size
    # allows, otherwise AQE splits the findings of a hot fingerprint
    listed = false_positives.select("target_pattern", "finding_evidence_hash").distinct().alias("fp")
    marked = findings.withColumn("_hash", fingerprint(F.col("evidence"))).alias("f")
    match = (F.col("f._hash") == F.col("fp.finding_evidence_hash")) & (
        (F.col("fp.target_pattern") == F.col("f.target")) | (F.col("fp.target_pattern") == EVERY_TARGET)
    )
    return marked.join(listed, match, how).drop("_hash")


def suppress(findings: DataFrame, false_positives: DataFrame) -> DataFrame:
    """Findings not listed for their ``target`` or for every target (F2)."""
    return _listed(findings, false_positives, "left_anti")


def suppressed(findings: DataFrame, false_positives: DataFrame) -> DataFrame:
    """The findings ``suppress`` drops; count them for F3."""
    return _listed(findings, false_positives, "left_semi")


def upsert_false_positives(old: DataFrame, new: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Merge two lists; the highest id per (pattern, fingerprint) stays, deleted ids go.

    A replaced entry leaves when it is replaced, so a later delete of the new one
    does not bring it back.
    """
    newest = Window.partitionBy("target_pattern", "finding_evidence_hash").orderBy(F.col("id").desc())
    merged = (
        old.unionByName(new)
        .withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") == 1)
        .drop("_rn")
    )
    return merged if deleted is None else merged.join(deleted.select("id"), "id", "left_anti")


def list_false_positives(entries: DataFrame, target_pattern: str | None = None) -> DataFrame:
    """Newest first, of one pattern or of all."""
    chosen = entries.where(F.col("target_pattern") == target_pattern) if target_pattern else entries
    return chosen.orderBy(F.col("id").desc())
