"""Alert digest per target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import SEVERITIES, severity_rank



def target_counts(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts per target and severity as one row per target, targets without findings included."""
    sums = [F.count(F.when(F.col("severity") == s, 1)).alias(s.lower()) for s in SEVERITIES]
    counted = findings.groupBy("target").agg(F.count("*").alias("total"), *sums)
    names = ["total"] + [s.lower() for s in SEVERITIES]
    return targets.select("target").distinct().join(counted, "target", "left").select(
        "target", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )


def alert_level(counts: DataFrame) -> DataFrame:
    """Worst finding decides the colour (B1)."""
    level = (
        F.when(F.col("critical") > 0, "red")
        .when(F.col("high") > 0, "orange")
        .when(F.col("total") == 0, "green")
        .otherwise("yellow")
    )
    return counts.withColumn("level", level)


def severity_text() -> Column:
    """``CRITICAL: 2 · LOW: 1``, or ``None`` if all counts are zero (B2)."""
    parts = [F.when(F.col(s.lower()) > 0, F.concat(F.lit(f"{s}: "), F.col(s.lower()))) for s in SEVERITIES]
    return F.coalesce(F.nullif(F.concat_ws(" · ", *parts), F.lit("")), F.lit("None"))


def top_findings(findings: DataFrame, k: int) -> DataFrame:
    """The k worst findings of every target (B3); each task keeps at most k per target."""
    order = Window.partitionBy("target").orderBy(
        severity_rank(F.col("severity")), "source_url", "line_number", "description", "evidence"
    )
    return findings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def digest(findings: DataFrame, targets: DataFrame, scan_date: Column) -> DataFrame:
    """One JSON message per target."""
    counts = alert_level(target_counts(findings, targets))
    by_severity = F.struct(*[F.col(s.lower()).alias(s) for s in SEVERITIES])
    message = F.to_json(
        F.struct(
            F.lit("scan_complete").alias("event"), "target", F.col("total").alias("total_findings"),
            by_severity.alias("severity_counts"), F.date_format(scan_date, "yyyy-MM-dd'T'HH:mm:ss").alias("scan_date"),
        )
    )
    return counts.select("target", "level", severity_text().alias("severity_text"), message.alias("message"))
