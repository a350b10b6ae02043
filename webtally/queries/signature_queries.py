"""Signature scan (G, R) and findings tables (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import findings as A
from ..operators.signatures import rules_frame, scan_signatures
from ..sources.assets import documents_as_assets, pages_as_assets, spread_small
from .corpus import AS_SHOWN, LEAKY_SQL, leaky_files, spread_rows, table
from .oracle import findings_ctes, rank
from .registry import query

DOC_ASSETS_SQL = """SELECT doc_id AS asset_id, 'doc://' || doc_id AS url, 'txt' AS file_type, text AS content FROM documents"""
PAGE_ASSETS_SQL = """SELECT page_id AS asset_id, url, 'html' AS file_type, html AS content FROM pages"""
FINDING_COLUMNS = (
    "asset_id, rule_id, severity, category, description, evidence, impact, recommendation, source_url, "
    "file_type, line_number, detector, pos, severity_rank"
)
DOC_FINDINGS_SQL = "WITH " + findings_ctes(DOC_ASSETS_SQL)
LEAKY_FINDINGS_SQL = "WITH " + findings_ctes(LEAKY_SQL)


def document_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_assets(spread_small(table(spark, sf_dir, "documents")))


def page_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_as_assets(spread_small(table(spark, sf_dir, "pages")))


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_signatures(document_assets(spark, sf_dir), limits=AS_SHOWN)


def leaky_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_signatures(leaky_files(spark, sf_dir), limits=AS_SHOWN)


@query("g1_signature_hits_documents", DOC_FINDINGS_SQL + f"SELECT {FINDING_COLUMNS} FROM findings")
def _(spark, sf_dir):
    return document_findings(spark, sf_dir)


@query("g1_signature_hits_pages", "WITH " + findings_ctes(PAGE_ASSETS_SQL) + f"SELECT {FINDING_COLUMNS} FROM findings")
def _(spark, sf_dir):
    return scan_signatures(page_assets(spark, sf_dir), limits=AS_SHOWN)


@query("g1_r1_r60_signature_hits_files", LEAKY_FINDINGS_SQL + f"SELECT {FINDING_COLUMNS} FROM findings")
def _(spark, sf_dir):
    return leaky_findings(spark, sf_dir)


# Whole evidence: files whose secrets are equal in their first 100 characters, or longer than 300.
LONG_SQL = """SELECT p_partkey AS asset_id, 'long://' || p_partkey AS url, 'js' AS file_type,
 'password = "' || repeat(md5(p_name), 4) || p_partkey || '"' || chr(10) || 'passwd = "' || repeat(md5(p_name), 4) || 'x' || p_partkey || '"' || chr(10)
 || '// TODO ' || repeat(p_name || ' ', 12) || p_partkey || chr(10) || 'pwd: "' || repeat(md5(p_name), 11) || '"' AS content FROM part"""


def long_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.md5("p_name")
    lines = [
        F.concat(F.lit('password = "'), F.repeat(digest, F.lit(4)), "p_partkey", F.lit('"')),
        F.concat(F.lit('passwd = "'), F.repeat(digest, F.lit(4)), F.lit("x"), "p_partkey", F.lit('"')),
        F.concat(F.lit("// TODO "), F.repeat(F.concat("p_name", F.lit(" ")), F.lit(12)), "p_partkey"),
        F.concat(F.lit('pwd: "'), F.repeat(digest, F.lit(11)), F.lit('"')),
    ]
    return spread_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select(
        F.col("p_partkey").alias("asset_id"), F.concat(F.lit("long://"), "p_partkey").alias("url"), F.lit("js").alias("file_type"),
        F.concat_ws("\n", *lines).alias("content"),
    )


def _whole_ctes(assets: str) -> str:
    return "WITH " + findings_ctes(assets, whole=True)


@query("g1_whole_evidence_long_files", _whole_ctes(LONG_SQL) + f"SELECT {FINDING_COLUMNS} FROM findings")
def _(spark, sf_dir):
    return scan_signatures(long_files(spark, sf_dir))


@query("g1_whole_evidence_documents", _whole_ctes(DOC_ASSETS_SQL) + f"SELECT {FINDING_COLUMNS} FROM findings")
def _(spark, sf_dir):
    return scan_signatures(document_assets(spark, sf_dir))


@query("g1_whole_evidence_files", _whole_ctes(LEAKY_SQL) + f"SELECT {FINDING_COLUMNS} FROM findings")
def _(spark, sf_dir):
    return scan_signatures(leaky_files(spark, sf_dir))


@query(
    "a2_whole_evidence",
    _whole_ctes(LONG_SQL) + "SELECT evidence, description, count(*) AS n FROM (SELECT DISTINCT asset_id % 5 AS site, evidence, description FROM findings) GROUP BY ALL",
)
def _(spark, sf_dir):
    """Findings as they are, without any bound on what is compared, counted over groups of files."""
    found = scan_signatures(long_files(spark, sf_dir)).withColumn("source_url", F.concat(F.lit("site"), F.col("asset_id") % 5))
    return A.dedupe_findings(found).groupBy("evidence", "description").agg(F.count("*").alias("n"))


@query(
    "g2_evidence_cut",
    LEAKY_FINDINGS_SQL + "SELECT asset_id, rule_id, line_number, length(evidence) AS evidence_chars, evidence FROM findings WHERE length(evidence) > 300",
)
def _(spark, sf_dir):
    found = leaky_findings(spark, sf_dir).withColumn("evidence_chars", F.length("evidence"))
    return found.where(F.col("evidence_chars") > 300).select("asset_id", "rule_id", "line_number", "evidence_chars", "evidence")


@query(
    "g3_first_hit_per_file",
    LEAKY_FINDINGS_SQL + "SELECT rule_id, count(*) AS n, count(DISTINCT asset_id) AS files, min(line_number) AS first_line FROM findings GROUP BY rule_id",
)
def _(spark, sf_dir):
    return leaky_findings(spark, sf_dir).groupBy("rule_id").agg(
        F.count("*").alias("n"), F.countDistinct("asset_id").alias("files"), F.min("line_number").alias("first_line")
    )


@query(
    "g4_rule_attributes",
    LEAKY_FINDINGS_SQL
    + "SELECT r.rule_id, r.name, r.severity, r.category, count(f.asset_id) AS n FROM rules r LEFT JOIN findings f USING (rule_id) GROUP BY ALL",
)
def _(spark, sf_dir):
    counts = leaky_findings(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("n"))
    rules = rules_frame(spark).select("rule_id", "name", "severity", "category")
    return rules.join(counts, "rule_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(
    "g5_prefilter_equals_full_scan",
    LEAKY_FINDINGS_SQL + "SELECT source_url, count(*) AS n, sum(rule_id)::BIGINT AS rule_sum, sum(line_number)::BIGINT AS line_sum FROM findings GROUP BY source_url",
)
def _(spark, sf_dir):
    found = scan_signatures(leaky_files(spark, sf_dir), prefilter=False, limits=AS_SHOWN)
    return found.groupBy("source_url").agg(
        F.count("*").alias("n"), F.sum("rule_id").alias("rule_sum"), F.sum("line_number").alias("line_sum")
    )


# -- findings tables ---------------------------------------------------------------

# Model findings derived from the conversations: every turn reports one finding,
# with a severity and an evidence picked by its keys, so that many are copies.
MODEL_FINDINGS_SQL = """SELECT conv_id AS asset_id, 0 AS rule_id,
 CASE (conv_id + turn) % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' WHEN 4 THEN 'STRANGE' ELSE NULL END AS severity,
 role AS category, 'turn ' || (turn % 3) AS description, role || ':' || (length(text) % 10) AS evidence, 'doc://' || (conv_id % 7) AS source_url, 'txt' AS file_type,
 CASE WHEN turn % 2 = 0 THEN NULL ELSE 'llm' END AS detector, turn AS line_number FROM conversations"""

MERGED_SQL = DOC_FINDINGS_SQL + f""", model AS ({MODEL_FINDINGS_SQL}),
merged AS (SELECT asset_id, severity, category, description, evidence, source_url, file_type, detector, line_number FROM findings
 UNION ALL SELECT asset_id, severity, category, description, evidence, source_url, file_type, coalesce(detector, 'llm'), line_number FROM model),
deduped AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY coalesce(source_url, ''), substr(coalesce(evidence, ''), 1, 100), coalesce(description, '')
 ORDER BY CASE WHEN detector = 'signature' THEN 0 ELSE 1 END, asset_id, line_number, {rank('severity')}, evidence) = 1)
"""


def model_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = (F.col("conv_id") + F.col("turn")) % 6
    severity = F.when(pick == 0, "CRITICAL").when(pick == 1, "HIGH").when(pick == 2, "MEDIUM").when(pick == 3, "LOW").when(pick == 4, "STRANGE")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("asset_id"), severity.alias("severity"), F.col("role").alias("category"),
        F.concat(F.lit("turn "), F.col("turn") % 3).alias("description"),
        F.concat("role", F.lit(":"), F.length("text") % 10).alias("evidence"),
        F.concat(F.lit("doc://"), F.col("conv_id") % 7).alias("source_url"), F.lit("txt").alias("file_type"),
        F.when(F.col("turn") % 2 != 0, "llm").alias("detector"), F.col("turn").alias("line_number"),
    )


def merged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["asset_id", "severity", "category", "description", "evidence", "source_url", "file_type", "detector", "line_number"]
    signature = document_findings(spark, sf_dir).select(*columns)
    return A.merge_findings(signature, model_findings(spark, sf_dir)).select(*columns)


def deduped_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dedupe_findings(merged_findings(spark, sf_dir), key_chars=100)


MERGED_COLUMNS = "asset_id, severity, category, description, evidence, source_url, file_type, detector, line_number"


@query("a1_merge_findings", MERGED_SQL + f"SELECT {MERGED_COLUMNS} FROM merged")
def _(spark, sf_dir):
    return merged_findings(spark, sf_dir)


@query("a2_dedupe_findings", MERGED_SQL + f"SELECT {MERGED_COLUMNS} FROM deduped")
def _(spark, sf_dir):
    return deduped_findings(spark, sf_dir)


@query("a3_ranked_findings", MERGED_SQL + f"SELECT {MERGED_COLUMNS}, ({rank('severity')})::BIGINT AS severity_rank FROM deduped")
def _(spark, sf_dir):
    return A.ranked(deduped_findings(spark, sf_dir))


@query("a4_severity_counts", MERGED_SQL + "SELECT coalesce(severity, 'UNKNOWN') AS severity, count(*) AS n FROM deduped GROUP BY 1")
def _(spark, sf_dir):
    return A.severity_counts(deduped_findings(spark, sf_dir))


@query("a5_detector_counts", MERGED_SQL + "SELECT coalesce(detector, 'unknown') AS detector, count(*) AS n FROM deduped GROUP BY 1")
def _(spark, sf_dir):
    return A.detector_counts(deduped_findings(spark, sf_dir))


TARGET_SQL = DOC_FINDINGS_SQL + """, targeted AS (SELECT f.*, d.source AS target FROM findings f JOIN documents d ON f.asset_id = d.doc_id)
"""


def targeted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document findings with the document's source as target, carried through the scan."""
    documents = spread_small(table(spark, sf_dir, "documents"))
    return scan_signatures(documents_as_assets(documents, F.col("source").alias("target")), keep=["target"], limits=AS_SHOWN)


@query(
    "a6_totals",
    TARGET_SQL + "SELECT d.source AS target, count(DISTINCT d.doc_id) AS files_scanned, "
    "(SELECT count(*) FROM targeted t WHERE t.target = d.source) AS total_findings FROM documents d GROUP BY d.source",
)
def _(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("target"))
    return A.totals(files, targeted_findings(spark, sf_dir), "target")


@query(
    "a7_file_details",
    DOC_FINDINGS_SQL + "SELECT a.asset_id, a.url, a.file_type, length(a.content) AS size, "
    "(SELECT count(*) FROM findings f WHERE f.asset_id = a.asset_id) AS sig_findings_count, '' AS summary FROM assets a",
)
def _(spark, sf_dir):
    return A.file_details(document_assets(spark, sf_dir), document_findings(spark, sf_dir))


@query(
    "a8_finding_rollup",
    MERGED_SQL + "SELECT severity, detector, category, count(*) AS n, grouping(severity, detector, category)::BIGINT AS level "
    "FROM deduped GROUP BY ROLLUP (severity, detector, category)",
)
def _(spark, sf_dir):
    return A.finding_rollup(deduped_findings(spark, sf_dir))


@query("a9_severity_filter", MERGED_SQL + f"SELECT {MERGED_COLUMNS} FROM deduped WHERE severity = 'HIGH'")
def _(spark, sf_dir):
    return A.with_severity(deduped_findings(spark, sf_dir), "HIGH")
