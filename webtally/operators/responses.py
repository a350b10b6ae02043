"""Parse stored model responses (L3, L4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import RESPONSE_BODY


def parse_responses(raw: DataFrame) -> DataFrame:
    """Outermost ``{…}`` of each response as a struct; text without one is a plain summary (L3)."""
    candidate = F.regexp_extract("raw", r"(?s)(\{.*\})", 1)
    # as the only element of an array, text after the object makes the value malformed
    wrapped = F.from_json(F.concat(F.lit("["), F.nullif(candidate, F.lit("")), F.lit("]")), f"ARRAY<STRUCT<{RESPONSE_BODY}>>")
    parsed = raw.withColumn("_all", wrapped)
    ok = F.coalesce(F.size("_all") == 1, F.lit(False)) & F.get("_all", F.lit(0)).isNotNull()
    parsed = parsed.withColumn("_body", F.get("_all", F.lit(0)))
    return parsed.select(
        "asset_id", "url", "file_type",
        F.when(ok, F.col("_body")).alias("body"),
        F.when(ok, F.coalesce(F.col("_body.summary"), F.lit(""))).otherwise(F.col("raw")).alias("summary"),
        (~ok).alias("is_raw"),
    )


def response_findings(parsed: DataFrame) -> DataFrame:
    """Findings of all responses, stamped with their file and detector (L4)."""
    rows = parsed.select("asset_id", "url", "file_type", F.explode_outer("body.findings").alias("f"))
    return rows.where(F.col("f").isNotNull()).select(
        "asset_id", "f.*", F.col("url").alias("source_url"), "file_type", F.lit("llm").alias("detector")
    )


def response_endpoints(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("asset_id", F.explode_outer("body.api_endpoints").alias("endpoint"))
    return rows.where(F.col("endpoint").isNotNull())


def response_flows(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("asset_id", F.explode_outer("body.data_flow_confirmed").alias("f"))
    return rows.where(F.col("f").isNotNull()).select("asset_id", "f.*")
