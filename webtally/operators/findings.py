"""Merge, de-duplicate, rank and count findings (A1–A10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import cut
from ..schema import severity_rank

TEXT_FIELDS = ["severity", "category", "description", "evidence", "impact", "recommendation", "source_url", "file_type"]


def merge_findings(signature: DataFrame, reported: DataFrame) -> DataFrame:
    """Signature findings and findings from model responses in one table (A1)."""
    other = reported.withColumn("detector", F.coalesce("detector", F.lit("llm")))
    return signature.unionByName(other, allowMissingColumns=True)


def dedupe_findings(findings: DataFrame, by: Sequence[str] = (), key_chars: int | None = None) -> DataFrame:
    """One finding per (by, url, evidence, description), signature rows first (A2).

    ``key_chars`` compares only so many characters of the evidence.

    Catalyst limits each key to one row per task before the shuffle, so copies of
    one finding never meet in a single task.
    """
    whole = ["source_url", "description", *(["evidence"] if key_chars is None else [])]
    missing = {c: f"_no_{c}" for c in whole}
    order = [
        F.when(F.col("detector") == "signature", 0).otherwise(1),
        *[F.col(c) for c in ("asset_id", "line_number", "pos") if c in findings.columns],
        # a whole evidence is part of the key: only a missing one and '' still differ
        severity_rank(F.col("severity")), F.col("evidence") if key_chars is not None else ~F.col(missing["evidence"]),
    ]
    # compared as they are, with a mark where a value is missing: no text is sorted twice
    marked = findings.withColumns({missing[c]: F.col(c).isNull() for c in whole}).withColumns({c: F.coalesce(c, F.lit("")) for c in whole})
    key = [*[F.col(c) for c in by], *[F.col(c) for c in whole]]
    if key_chars is not None:
        key.append(cut(F.coalesce("evidence", F.lit("")), key_chars))
    window = Window.partitionBy(*key).orderBy(*order)
    first = marked.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1)
    return first.withColumns({c: F.when(~F.col(m), F.col(c)) for c, m in missing.items()}).select(*findings.columns)


def ranked(findings: DataFrame) -> DataFrame:
    """Worst severity first (A3)."""
    keys = [c for c in ("source_url", "line_number", "description", "evidence") if c in findings.columns]
    return findings.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy("severity_rank", *keys)


def severity_counts(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    severity = F.coalesce("severity", F.lit("UNKNOWN")).alias("severity")
    return findings.groupBy(*by, severity).agg(F.count("*").alias("n"))


def detector_counts(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    detector = F.coalesce("detector", F.lit("unknown")).alias("detector")
    return findings.groupBy(*by, detector).agg(F.count("*").alias("n"))


def totals(files: DataFrame, findings: DataFrame, by: str) -> DataFrame:
    """Files scanned and findings per ``by``, including those without findings."""
    scanned = files.groupBy(by).agg(F.count("*").alias("files_scanned"))
    found = findings.groupBy(by).agg(F.count("*").alias("total_findings"))
    return scanned.join(found, by, "left").withColumn("total_findings", F.coalesce("total_findings", F.lit(0)))


def scan_totals(files: DataFrame, findings: DataFrame) -> DataFrame:
    """The same totals for a single scan, as one row: counted together, without a join."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    scanned = files.select(one.alias("f"), none.alias("t"))
    found = findings.select(none.alias("f"), one.alias("t"))
    sums = scanned.unionByName(found).agg(F.sum("f").alias("f"), F.sum("t").alias("t"))
    return sums.select(F.coalesce("f", F.lit(0)).alias("files_scanned"), F.coalesce("t", F.lit(0)).alias("total_findings"))


def file_details(files: DataFrame, signature: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Size, signature findings and summary of every file.

    Findings are counted per file before the join, which is then one row to one.
    """
    counts = signature.groupBy("asset_id").agg(F.count("*").alias("sig_findings_count"))
    out = files.select("asset_id", "url", "file_type", F.length("content").alias("size")).join(counts, "asset_id", "left")
    out = out.withColumn("sig_findings_count", F.coalesce("sig_findings_count", F.lit(0)))
    if responses is None:
        return out.withColumn("summary", F.lit(""))
    return out.join(responses.select("asset_id", "summary"), "asset_id", "left").withColumn(
        "summary", F.coalesce("summary", F.lit(""))
    )


def finding_rollup(findings: DataFrame) -> DataFrame:
    """Counts by severity, detector and category with subtotals."""
    return findings.rollup("severity", "detector", "category").agg(
        F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")
    )


def with_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(F.col("severity") == severity)


def exploitable(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("exploitable"))


def finding_key(evidence_chars: int | None = None) -> list[Column]:
    """Description, URL and evidence (or its first characters), missing values as ''."""
    return [
        F.coalesce("description", F.lit("")).alias("k_description"),
        F.coalesce("source_url", F.lit("")).alias("k_source_url"),
        cut(F.coalesce("evidence", F.lit("")), evidence_chars).alias("k_evidence"),
    ]
