"""Suppression (F), diff (X), history (T), digest (B) and model tables (L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog.rules import RULES
from ..limits import Limits
from ..operators import diff as X
from ..operators import digest as B
from ..operators import findings as A
from ..operators import history as T
from ..operators import responses as L
from ..operators import suppression as S
from ..operators.briefing import prompts
from ..operators.signatures import scan_signatures
from ..sources.assets import documents_as_assets, spread_small
from ..sources.store import report_counts, report_json
from .corpus import AS_SHOWN, LEAKY_SQL, leaky_files, table
from .oracle import findings_ctes, rank
from .registry import query
from .signature_queries import LEAKY_FINDINGS_SQL, LONG_SQL, leaky_findings, long_files

# -- suppression: targets are the hosts of the derived files -----------------------

TARGETED_SQL = LEAKY_FINDINGS_SQL + """, targeted AS (SELECT *, split_part(source_url, '/', 3) AS target FROM findings),
fps AS (SELECT s_suppkey AS id, 's' || (s_suppkey % 50) || '.example.com' AS target_pattern, 'key' AS finding_description,
   sha256('sk_live_' || md5(s_suppkey::VARCHAR))[1:32] AS finding_evidence_hash FROM supplier
 UNION ALL SELECT 1000000 + s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '*' ELSE 's1.example.com' END, 'address',
   sha256(CASE WHEN s_suppkey % 2 = 0 THEN '10.1.2.3' ELSE '192.168.1.1' END)[1:32] FROM supplier)
"""
HIDDEN = """EXISTS (SELECT 1 FROM fps p WHERE p.finding_evidence_hash = sha256(t.evidence)[1:32]
 AND (p.target_pattern = t.target OR p.target_pattern = '*'))"""


def targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaky_findings(spark, sf_dir).withColumn("target", F.split("source_url", "/")[2])


def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    supplier = table(spark, sf_dir, "supplier")
    even = k % 2 == 0
    keys = supplier.select(
        k.alias("id"), F.concat(F.lit("s"), k % 50, F.lit(".example.com")).alias("target_pattern"),
        F.lit("key").alias("finding_description"),
        S.fingerprint(F.concat(F.lit("sk_live_"), F.md5(k.cast("string")))).alias("finding_evidence_hash"),
    )
    addresses = supplier.select(
        (k + 1000000).alias("id"), F.when(even, "*").otherwise("s1.example.com").alias("target_pattern"),
        F.lit("address").alias("finding_description"),
        S.fingerprint(F.when(even, "10.1.2.3").otherwise("192.168.1.1")).alias("finding_evidence_hash"),
    )
    return keys.unionByName(addresses)


@query("f1_fingerprint", LEAKY_FINDINGS_SQL + "SELECT asset_id, rule_id, evidence, sha256(evidence)[1:32] AS fingerprint FROM findings")
def _(spark, sf_dir):
    return leaky_findings(spark, sf_dir).select("asset_id", "rule_id", "evidence", S.fingerprint(F.col("evidence")).alias("fingerprint"))


@query("f2_suppress", TARGETED_SQL + f"SELECT asset_id, rule_id, target, evidence FROM targeted t WHERE NOT {HIDDEN}")
def _(spark, sf_dir):
    kept = S.suppress(targeted(spark, sf_dir), false_positives(spark, sf_dir))
    return kept.select("asset_id", "rule_id", "target", "evidence")


@query("f3_suppressed_count", TARGETED_SQL + f"SELECT target, count(*) AS n FROM targeted t WHERE {HIDDEN} GROUP BY target")
def _(spark, sf_dir):
    gone = S.suppressed(targeted(spark, sf_dir), false_positives(spark, sf_dir))
    return gone.groupBy("target").agg(F.count("*").alias("n"))


@query(
    "f4_counts_after_suppression",
    TARGETED_SQL + f"""SELECT target, severity, detector, count(*) AS n FROM targeted t WHERE NOT {HIDDEN} GROUP BY ALL""",
)
def _(spark, sf_dir):
    kept = S.suppress(targeted(spark, sf_dir), false_positives(spark, sf_dir))
    return A.severity_counts(kept, ["target", "detector"])


UPSERT_SQL = """WITH old AS (SELECT s_suppkey AS id, 's' || (s_suppkey % 50) AS target_pattern, md5((s_suppkey % 30)::VARCHAR) AS finding_evidence_hash, 'old' AS reason FROM supplier),
new AS (SELECT 1000000 + p_partkey AS id, 's' || (p_partkey % 50) AS target_pattern, md5((p_partkey % 60)::VARCHAR) AS finding_evidence_hash, p_brand AS reason FROM part),
gone AS (SELECT 1000000 + c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0),
kept AS (SELECT * FROM (SELECT * FROM old UNION ALL SELECT * FROM new)
 QUALIFY row_number() OVER (PARTITION BY target_pattern, finding_evidence_hash ORDER BY id DESC) = 1)
"""


def maintained_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    def entries(name: str, key: str, shift: int, buckets: int, reason) -> DataFrame:
        k = F.col(key)
        return table(spark, sf_dir, name).select(
            (k + shift).alias("id"), F.concat(F.lit("s"), k % 50).alias("target_pattern"),
            F.md5((k % buckets).cast("string")).alias("finding_evidence_hash"), reason.alias("reason"),
        )

    old = entries("supplier", "s_suppkey", 0, 30, F.lit("old"))
    new = entries("part", "p_partkey", 1000000, 60, F.col("p_brand"))
    gone = (
        table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") + 1000000).alias("id"))
        .union(table(spark, sf_dir, "supplier").where("s_acctbal < 0").select("s_suppkey"))
    )
    return S.upsert_false_positives(old, new, gone)


@query(
    "f5_upsert_false_positives",
    UPSERT_SQL + "SELECT id, target_pattern, finding_evidence_hash, reason FROM kept WHERE id NOT IN (SELECT id FROM gone)",
)
def _(spark, sf_dir):
    return maintained_list(spark, sf_dir)


@query(
    "f6_list_false_positives",
    UPSERT_SQL + "SELECT id, target_pattern, reason FROM kept WHERE id NOT IN (SELECT id FROM gone) AND target_pattern = 's7'",
)
def _(spark, sf_dir):
    return S.list_false_positives(maintained_list(spark, sf_dir), "s7").select("id", "target_pattern", "reason")


# -- diff: the new scan sees revised files and a re-rated catalogue -----------------

RERATED = [r._replace(severity="MEDIUM") if r.severity == "LOW" else r for r in RULES]
REVISED_SQL = f"SELECT asset_id, url, file_type, replace(replace(content, 'example.com', 'example.org'), 'sk_live_', 'sk_old_') AS content FROM ({LEAKY_SQL})"
RERATED_SEVERITY = "CASE r.severity WHEN 'LOW' THEN 'MEDIUM' ELSE r.severity END"


def _diff_sql(old: str, new: str, whole: bool = False) -> str:
    """CTEs up to ``diff``; ``whole`` compares all of the evidence, else its first 80 characters."""
    evidence = "coalesce(evidence, '')" if whole else "substr(coalesce(evidence, ''), 1, 80)"

    def keyed(prefix: str) -> str:
        return (
            f"SELECT *, {evidence} AS k_evidence FROM {prefix}findings QUALIFY row_number() OVER "
            f"(PARTITION BY description, source_url, {evidence} ORDER BY severity_rank DESC, line_number DESC, evidence DESC) = 1"
        )

    return (
        "WITH " + findings_ctes(old, "old_", whole=whole) + ", " + findings_ctes(new, "new_", RERATED_SEVERITY, whole=whole)
        + f", o AS ({keyed('old_')}), n AS ({keyed('new_')})"
        + f""", diff AS (SELECT CASE WHEN o.asset_id IS NULL THEN 'new' WHEN n.asset_id IS NULL THEN 'resolved'
 WHEN o.severity <> n.severity THEN 'changed' ELSE 'unchanged' END AS status, o.severity AS old_severity, n.severity AS new_severity,
 coalesce(n.description, o.description) AS description, coalesce(n.source_url, o.source_url) AS source_url,
 coalesce(n.evidence, o.evidence) AS evidence, ({rank('coalesce(n.severity, o.severity)')})::BIGINT AS severity_rank
 FROM o FULL OUTER JOIN n ON o.description = n.description AND o.source_url = n.source_url AND o.k_evidence = n.k_evidence)
"""
    )


DIFF_SQL = _diff_sql(LEAKY_SQL, REVISED_SQL)
DIFF_COLUMNS = "status, old_severity, new_severity, description, source_url, evidence, severity_rank"


def revised_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.replace("content", F.lit("example.com"), F.lit("example.org")), F.lit("sk_live_"), F.lit("sk_old_"))
    return leaky_files(spark, sf_dir).withColumn("content", text)


def old_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaky_findings(spark, sf_dir)


def new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_signatures(revised_files(spark, sf_dir), RERATED, limits=AS_SHOWN)


def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.diff_findings(old_findings(spark, sf_dir), new_findings(spark, sf_dir), key_chars=80)


@query("x1_keyed_findings", DIFF_SQL + "SELECT description AS k_description, source_url AS k_source_url, k_evidence, severity, line_number, evidence FROM o")
def _(spark, sf_dir):
    keyed = X.keyed_findings(old_findings(spark, sf_dir), key_chars=80)
    return keyed.select(*X.KEY, "f.severity", "f.line_number", "f.evidence")


for _id, _status in (("x2_new_findings", "new"), ("x3_resolved_findings", "resolved"), ("x4_changed_severity", "changed")):

    @query(_id, DIFF_SQL + f"SELECT {DIFF_COLUMNS} FROM diff WHERE status = '{_status}'")
    def _(spark, sf_dir, status=_status):
        return scan_diff(spark, sf_dir).where(F.col("status") == status)


@query("x11_ranked_diff", DIFF_SQL + f"SELECT {DIFF_COLUMNS} FROM diff WHERE status <> 'unchanged'")
def _(spark, sf_dir):
    return X.ranked_diff(scan_diff(spark, sf_dir))


@query(
    "x10_diff_summary",
    DIFF_SQL + "SELECT count(*) FILTER (status = 'new') AS new_findings, count(*) FILTER (status = 'resolved') AS resolved_findings, "
    "count(*) FILTER (status = 'changed') AS changed_severity FROM diff",
)
def _(spark, sf_dir):
    return X.diff_summary(scan_diff(spark, sf_dir))


# Whole evidence: in the revised long files a secret is another one behind its first 100 characters only.
REVISED_LONG_SQL = f"SELECT asset_id, url, file_type, replace(content, 'x' || asset_id || '\"', 'y' || asset_id || '\"') AS content FROM ({LONG_SQL})"
WHOLE_DIFF_SQL = _diff_sql(LONG_SQL, REVISED_LONG_SQL, whole=True)


def whole_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.concat(F.col("asset_id"), F.lit('"'))
    revised = F.replace("content", F.concat(F.lit("x"), tail), F.concat(F.lit("y"), tail))
    old = long_files(spark, sf_dir)
    return X.diff_findings(scan_signatures(old), scan_signatures(old.withColumn("content", revised), RERATED))


@query("x1_whole_keyed_findings", WHOLE_DIFF_SQL + "SELECT description AS k_description, source_url AS k_source_url, k_evidence, severity, line_number, evidence FROM o")
def _(spark, sf_dir):
    keyed = X.keyed_findings(scan_signatures(long_files(spark, sf_dir)))
    return keyed.select(*X.KEY, "f.severity", "f.line_number", "f.evidence")


@query("x2_x4_whole_diff", WHOLE_DIFF_SQL + f"SELECT {DIFF_COLUMNS} FROM diff")
def _(spark, sf_dir):
    return whole_diff(spark, sf_dir)


@query(
    "x8_severity_delta",
    DIFF_SQL + """SELECT severity, coalesce(a.n, 0) AS old, coalesce(b.n, 0) AS new, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta
 FROM (SELECT severity, count(*) AS n FROM old_findings GROUP BY 1) a FULL OUTER JOIN (SELECT severity, count(*) AS n FROM new_findings GROUP BY 1) b USING (severity)
 WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
)
def _(spark, sf_dir):
    return X.diff_counts(A.severity_counts(old_findings(spark, sf_dir)), A.severity_counts(new_findings(spark, sf_dir)))


@query(
    "x9_diff_headers",
    DIFF_SQL + """SELECT 'old' AS scan, (SELECT count(*) FROM old_assets) AS files_scanned, (SELECT count(*) FROM old_findings) AS total_findings
 UNION ALL SELECT 'new', (SELECT count(*) FROM new_assets), (SELECT count(*) FROM new_findings)""",
)
def _(spark, sf_dir):
    return X.diff_headers(
        A.scan_totals(leaky_files(spark, sf_dir), old_findings(spark, sf_dir)),
        A.scan_totals(revised_files(spark, sf_dir), new_findings(spark, sf_dir)),
    )


@query(
    "x7_files_diff",
    """SELECT url, 'added' AS change FROM (SELECT DISTINCT split_part(split_part(url, '#', 1), '?', 1) AS url FROM pages EXCEPT SELECT DISTINCT url FROM pages)
 UNION ALL SELECT url, 'removed' FROM (SELECT DISTINCT url FROM pages EXCEPT SELECT DISTINCT split_part(split_part(url, '#', 1), '?', 1) FROM pages)""",
)
def _(spark, sf_dir):
    old = table(spark, sf_dir, "pages").select("url")
    new = old.select(F.split(F.split("url", "#")[0], r"\?")[0].alias("url"))
    return X.diff_sets(old, new, ["url"])


# -- history -----------------------------------------------------------------------

SCANS_SQL = """WITH scans AS (SELECT o_orderkey AS id, o_custkey AS user_id, 'https://t' || (o_orderkey % 97) || '.example.com' AS target_url,
 CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'error' END AS status,
 CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS finished_at FROM orders),
users AS (SELECT c_custkey AS user_id, c_name AS username FROM customer)
"""


def scans_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "done").otherwise("error")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("https://t"), F.col("o_orderkey") % 97, F.lit(".example.com")).alias("target_url"),
        status.alias("status"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("finished_at"),
    )


def users_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))


@query("t1_scan_history", SCANS_SQL + "SELECT s.*, username FROM scans s JOIN users USING (user_id) ORDER BY id DESC LIMIT 50")
def _(spark, sf_dir):
    return T.scan_history(scans_table(spark, sf_dir), users_table(spark, sf_dir), is_admin=True, limit=50)


@query("t2_own_scans", SCANS_SQL + "SELECT s.*, username FROM scans s JOIN users USING (user_id) WHERE user_id = 7 ORDER BY id DESC LIMIT 50")
def _(spark, sf_dir):
    return T.scan_history(scans_table(spark, sf_dir), users_table(spark, sf_dir), principal=7, limit=50)


@query("t4_active_scans", SCANS_SQL + "SELECT * FROM scans WHERE status = 'running' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) = 1")
def _(spark, sf_dir):
    return T.active_scans(scans_table(spark, sf_dir))


@query(
    "t5_latest_progress",
    """SELECT l_orderkey AS scan_id, l_quantity::BIGINT AS progress, l_returnflag || l_linestatus AS progress_msg FROM lineitem
 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) = 1""",
)
def _(spark, sf_dir):
    log = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scan_id"), F.col("l_shipdate").alias("ts"),
        F.struct("l_linenumber", "l_partkey").alias("seq"), F.col("l_quantity").cast("bigint").alias("progress"),
        F.concat("l_returnflag", "l_linestatus").alias("progress_msg"),
    )
    return T.latest_progress(log)


@query(
    "t6_parse_counts",
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey % 5 END AS high,
 CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey % 3 END AS low, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 2 END::BIGINT AS entries FROM orders""",
)
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(F.col("o_orderstatus") == "P", "").otherwise(
        F.concat(F.lit('{"HIGH": '), k % 5, F.lit(', "LOW": '), k % 3, F.lit("}"))
    )
    parsed = table(spark, sf_dir, "orders").select(k.alias("id"), T.parse_counts(text).alias("c"))
    return parsed.select("id", F.col("c")["HIGH"].alias("high"), F.col("c")["LOW"].alias("low"), F.size("c").alias("entries"))


CUT = "TIMESTAMP '1998-01-01 00:00:00'"
KEPT_SQL = f"SELECT * FROM scans WHERE NOT coalesce(finished_at < {CUT} - INTERVAL 90 DAY AND status IN ('done', 'error'), false)"


def kept_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return T.retain(scans_table(spark, sf_dir), "finished_at", now, 90, T.FINISHED)


@query("t7_scan_retention", SCANS_SQL + KEPT_SQL)
def _(spark, sf_dir):
    return kept_scans(spark, sf_dir)


@query(
    "t7_finding_cascade",
    SCANS_SQL + f"SELECT l_returnflag AS severity, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT id FROM ({KEPT_SQL})) GROUP BY 1",
)
def _(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_returnflag").alias("severity"))
    return A.severity_counts(T.retain_findings(found, kept_scans(spark, sf_dir)))


def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", "user_id", F.col("event_type").alias("action"),
        F.when(F.col("event_type") == "error", "warn").otherwise("info").alias("severity"), F.col("props").alias("detail"),
    )


AUDIT_SQL = "SELECT event_id AS id, ts, user_id, event_type AS action, CASE event_type WHEN 'error' THEN 'warn' ELSE 'info' END AS severity, props AS detail FROM events"


@query("t8_audit_retention", f"SELECT * FROM ({AUDIT_SQL}) WHERE ts >= TIMESTAMP '2024-07-14 00:00:00' - INTERVAL 180 DAY")
def _(spark, sf_dir):
    return T.retain(audit_table(spark, sf_dir), "ts", F.lit("2024-07-14 00:00:00").cast("timestamp_ntz"), 180)


@query("t9_audit_query", f"SELECT * FROM ({AUDIT_SQL}) WHERE action = 'error' AND severity = 'warn' ORDER BY id DESC LIMIT 200")
def _(spark, sf_dir):
    return T.audit_query(audit_table(spark, sf_dir), action="error", severity="warn", limit=200)


@query(
    "t11_protect_and_reveal",
    "SELECT doc_id, text <> '' AS protected, md5(text) AS revealed_md5, md5(text) AS legacy_md5, true AS wrong_key_keeps FROM documents",
)
def _(spark, sf_dir):
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    sealed = table(spark, sf_dir, "documents").select("doc_id", "text", T.protect(F.col("text"), key).alias("sealed"))
    return sealed.select(
        "doc_id", T.is_protected(F.col("sealed")).alias("protected"),
        F.md5(T.reveal(F.col("sealed"), key)).alias("revealed_md5"), F.md5(T.reveal(F.col("text"), key)).alias("legacy_md5"),
        (T.reveal(F.col("sealed"), other) == F.col("sealed")).alias("wrong_key_keeps"),
    )


# -- digest --------------------------------------------------------------------------

COUNTS_SQL = TARGETED_SQL + """, targets AS (SELECT DISTINCT 's' || (s_suppkey % 60) || '.example.com' AS target FROM supplier),
counts AS (SELECT g.target, count(t.target) AS total, count(*) FILTER (t.severity = 'CRITICAL') AS critical, count(*) FILTER (t.severity = 'HIGH') AS high,
 count(*) FILTER (t.severity = 'MEDIUM') AS medium, count(*) FILTER (t.severity = 'LOW') AS low, count(*) FILTER (t.severity = 'INFO') AS info
 FROM targets g LEFT JOIN targeted t USING (target) GROUP BY g.target),
digest AS (SELECT *, CASE WHEN critical > 0 THEN 'red' WHEN high > 0 THEN 'orange' WHEN total = 0 THEN 'green' ELSE 'yellow' END AS level,
 coalesce(nullif(concat_ws(' · ', CASE WHEN critical > 0 THEN 'CRITICAL: ' || critical END, CASE WHEN high > 0 THEN 'HIGH: ' || high END,
  CASE WHEN medium > 0 THEN 'MEDIUM: ' || medium END, CASE WHEN low > 0 THEN 'LOW: ' || low END, CASE WHEN info > 0 THEN 'INFO: ' || info END), ''), 'None') AS severity_text FROM counts)
"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey") % 60, F.lit(".example.com")).alias("target"))


@query("b1_alert_level", COUNTS_SQL + "SELECT target, total, critical, high, medium, low, info, level FROM digest")
def _(spark, sf_dir):
    return B.alert_level(B.target_counts(targeted(spark, sf_dir), targets(spark, sf_dir)))


@query("b2_severity_text", COUNTS_SQL + "SELECT target, severity_text FROM digest")
def _(spark, sf_dir):
    counts = B.target_counts(targeted(spark, sf_dir), targets(spark, sf_dir))
    return counts.select("target", B.severity_text().alias("severity_text"))


@query(
    "b3_top_findings",
    TARGETED_SQL + "SELECT target, severity, description, source_url, line_number, evidence, row_number() OVER (PARTITION BY target "
    "ORDER BY severity_rank, source_url, line_number, description, evidence) AS rank FROM targeted QUALIFY rank <= 10",
)
def _(spark, sf_dir):
    top = B.top_findings(targeted(spark, sf_dir), k=10)
    return top.select("target", "severity", "description", "source_url", "line_number", "evidence", "rank")


@query(
    "b4_digest",
    COUNTS_SQL + """SELECT target, level, severity_text, '{"event":"scan_complete","target":"' || target || '","total_findings":' || total
 || ',"severity_counts":{"CRITICAL":' || critical || ',"HIGH":' || high || ',"MEDIUM":' || medium || ',"LOW":' || low || ',"INFO":' || info
 || '},"scan_date":"2024-01-31T12:00:00"}' AS message FROM digest""",
)
def _(spark, sf_dir):
    date = F.lit("2024-01-31 12:00:00").cast("timestamp")
    return B.digest(targeted(spark, sf_dir), targets(spark, sf_dir), date)


# -- report as JSON lines -------------------------------------------------------------

@query(
    "s8_report_lines",
    TARGETED_SQL + """, byscan AS (SELECT (split_part(target, '.', 1)[2:])::BIGINT AS scan_id, * FROM targeted)
SELECT scan_id, 'findings' AS part, count(*) AS lines, sum(line_number)::BIGINT AS line_sum, NULL::BIGINT AS total_findings FROM byscan GROUP BY 1
UNION ALL SELECT scan_id, 'report', 1, NULL, count(*) FROM byscan GROUP BY 1""",
)
def _(spark, sf_dir):
    found = targeted(spark, sf_dir).withColumn("scan_id", F.regexp_extract("target", r"^s(\d+)\.", 1).cast("bigint"))
    scans = report_counts(found).withColumn("model", F.lit("none"))
    lines = report_json(scans, findings=found.select("scan_id", "severity", "description", "evidence", "line_number"))
    value = F.get_json_object("json", "$.line_number").cast("bigint")
    total = F.get_json_object("json", "$.total_findings").cast("bigint")
    return lines.groupBy("scan_id", "part").agg(
        F.count("*").alias("lines"), F.sum(value).alias("line_sum"), F.sum(total).alias("total_findings")
    )


# -- model requests and responses -------------------------------------------------------

def _prompts_sql(content: str) -> str:
    return f"""SELECT doc_id AS asset_id, 'doc://' || doc_id AS url, 'txt' AS file_type, md5('File: doc://' || doc_id || chr(10) || 'Type: txt' || chr(10) || chr(10)
 || '═══ DETERMINISTIC BRIEFING ═══' || chr(10) || source || chr(10) || '═══ END BRIEFING ═══' || chr(10) || chr(10) || 'File content:' || chr(10) || '```' || chr(10)
 || {content} || chr(10) || '```') AS prompt_md5 FROM documents"""


def document_prompts(spark: SparkSession, sf_dir: str, *limits: Limits) -> DataFrame:
    documents = spread_small(table(spark, sf_dir, "documents"))
    briefed = documents_as_assets(documents, F.col("source").alias("briefing"))
    return prompts(briefed, *limits).select("asset_id", "url", "file_type", F.md5("prompt").alias("prompt_md5"))


@query("l2_prompts", _prompts_sql("CASE WHEN length(text) > 15000 THEN substr(text, 1, 15000) || chr(10) || chr(10) || '... [TRUNCATED] ...' ELSE text END"))
def _(spark, sf_dir):
    return document_prompts(spark, sf_dir, AS_SHOWN)


@query("l2_whole_prompts", _prompts_sql("text"))
def _(spark, sf_dir):
    return document_prompts(spark, sf_dir)


def responses_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response per conversation turn: clean JSON, JSON in prose, broken JSON,
    plain text, or two objects, by key."""
    form, digest = F.col("conv_id") % 5, F.md5("text")
    body = F.concat(
        F.lit('{"findings": [{"severity": "HIGH", "category": "'), "role", F.lit('", "description": "d'), "turn",
        F.lit('", "evidence": "'), digest, F.lit('"}], "api_endpoints": ["GET /m/'), "turn",
        F.lit('"], "data_flow_confirmed": [{"source": "s", "sink": "'), digest, F.lit('", "exploitable": '),
        F.when(F.col("turn") % 2 == 0, "true").otherwise("false"), F.lit('}], "summary": "ok '), "role", F.lit('"}'),
    )
    raw = (
        F.when(form == 0, body).when(form == 1, F.concat(F.lit("Sure:\n"), body, F.lit("\nDone.")))
        .when(form == 2, F.concat(F.lit('{"findings": [ '), digest)).when(form == 3, F.col("role"))
        .otherwise(F.concat(body, F.lit(" and "), body))
    )
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("asset_id"), F.concat(F.lit("conv://"), "conv_id").alias("url"),
        F.lit("txt").alias("file_type"), raw.alias("raw"),
    )


L_ID = "conv_id * 1000 + turn AS asset_id"
RESPONSE_SQL = """('{"findings": [{"severity": "HIGH", "category": "' || role || '", "description": "d' || turn || '", "evidence": "' || md5(text)
 || '"}], "api_endpoints": ["GET /m/' || turn || '"], "data_flow_confirmed": [{"source": "s", "sink": "' || md5(text) || '", "exploitable": '
 || CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END || '}], "summary": "ok ' || role || '"}')"""


@query(
    "l3_parse_responses",
    f"""SELECT {L_ID}, conv_id % 5 NOT IN (0, 1) AS is_raw, CASE WHEN conv_id % 5 IN (0, 1) THEN 'ok ' || role WHEN conv_id % 5 = 2 THEN '{{{{"findings": [ ' || md5(text)
 WHEN conv_id % 5 = 3 THEN role END AS summary FROM conversations WHERE conv_id % 5 <> 4
 UNION ALL SELECT {L_ID}, true, {{body}} || ' and ' || {{body}} FROM conversations WHERE conv_id % 5 = 4""".format(body=RESPONSE_SQL),
)
def _(spark, sf_dir):
    return L.parse_responses(responses_table(spark, sf_dir)).select("asset_id", "is_raw", "summary")


@query(
    "l4_response_findings",
    f"""SELECT {L_ID}, 'HIGH' AS severity, role AS category, 'd' || turn AS description, md5(text) AS evidence, 'conv://' || conv_id AS source_url, 'llm' AS detector
 FROM conversations WHERE conv_id % 5 IN (0, 1)""",
)
def _(spark, sf_dir):
    found = L.response_findings(L.parse_responses(responses_table(spark, sf_dir)))
    return found.select("asset_id", "severity", "category", "description", "evidence", "source_url", "detector")


@query("l4_response_endpoints", f"SELECT {L_ID}, 'GET /m/' || turn AS endpoint FROM conversations WHERE conv_id % 5 IN (0, 1)")
def _(spark, sf_dir):
    return L.response_endpoints(L.parse_responses(responses_table(spark, sf_dir)))


@query("a10_exploitable_flows", f"SELECT {L_ID}, 's' AS source, md5(text) AS sink, true AS exploitable FROM conversations WHERE conv_id % 5 IN (0, 1) AND turn % 2 = 0")
def _(spark, sf_dir):
    flows = L.response_flows(L.parse_responses(responses_table(spark, sf_dir)))
    return A.exploitable(flows).select("asset_id", "source", "sink", "exploitable")


