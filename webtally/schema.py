"""Table schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

ASSETS = "asset_id BIGINT, url STRING, file_type STRING, content STRING, size INT"
PAGES = "page_id BIGINT, url STRING, html STRING"
FETCHED = "asset_id BIGINT, url STRING, content STRING, status INT, content_type STRING"
REQUESTS = "page_url STRING, url STRING, method STRING, resource_type STRING, headers MAP<STRING,STRING>"
FINDINGS = (
    "scan_id BIGINT, severity STRING, category STRING, description STRING, evidence STRING, impact STRING, "
    "recommendation STRING, source_url STRING, file_type STRING, line_number INT, detector STRING"
)
DEPENDENCIES = "name STRING, version STRING, source STRING, vulnerable BOOLEAN, cve STRING"
FALSE_POSITIVES = (
    "id BIGINT, target_pattern STRING, finding_description STRING, finding_evidence_hash STRING, "
    "reason STRING, created_by BIGINT, created_at TIMESTAMP"
)
USERS = "user_id BIGINT, username STRING, role STRING, created_at TIMESTAMP"
SCANS = (
    "id BIGINT, user_id BIGINT, target_url STRING, model STRING, status STRING, progress INT, "
    "progress_msg STRING, files_scanned BIGINT, total_findings BIGINT, severity_counts STRING, "
    "started_at TIMESTAMP, finished_at TIMESTAMP"
)
AUDIT = (
    "id BIGINT, ts TIMESTAMP, user_id BIGINT, username STRING, ip STRING, action STRING, "
    "detail STRING, severity STRING"
)
AUTH_ATTEMPTS = "ts TIMESTAMP, ip STRING, username STRING, success BOOLEAN"
USER_REQUESTS = "ts TIMESTAMP, user_id BIGINT"
RESPONSES = "asset_id BIGINT, url STRING, file_type STRING, raw STRING"
RESPONSE_BODY = (
    "findings: ARRAY<STRUCT<severity: STRING, category: STRING, description: STRING, evidence: STRING, "
    "impact: STRING, recommendation: STRING>>, "
    "data_flow_confirmed: ARRAY<STRUCT<source: STRING, sink: STRING, exploitable: BOOLEAN, explanation: STRING>>, "
    "api_endpoints: ARRAY<STRING>, summary: STRING"
)

# Severities from worst to mildest.
SEVERITIES: list[str] = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


def severity_rank(severity: Column) -> Column:
    """1 for CRITICAL … 5 for INFO, 6 for anything else; a missing one ranks as INFO."""
    known = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.coalesce(severity, F.lit("INFO")))
    return F.coalesce(F.nullif(known, F.lit(0)), F.lit(6)).cast("int")


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
