"""Briefings (L1) and the audit tables they are built from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import code
from ..operators.briefing import briefings, with_extracts
from ..operators.facts import KINDS
from ..plans.audit import extract, tables
from ..session import shared_folder
from .code_queries import BASE_SQL, DEPS_SQL, ENDPOINT_SQL, FACT_SQL, FLOW_SQL
from .corpus import AS_SHOWN, CODE_SQL, LEAKY_SQL, code_files, leaky_files, quote
from .oracle import findings_ctes
from .registry import query

SHIFT = 10_000_000


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    code_part = code_files(spark, sf_dir).withColumn("asset_id", F.col("asset_id") + SHIFT)
    return leaky_files(spark, sf_dir).unionByName(code_part)


ALL_FILES_SQL = f"{LEAKY_SQL} UNION ALL SELECT asset_id + {SHIFT}, url, file_type, content FROM ({CODE_SQL})"


def _part(sql: str) -> str:
    """The CTEs of another query without the base they share."""
    return sql.replace(BASE_SQL, "", 1)


def listed(rows: str, text: str, order: str, cap: str) -> str:
    """First rows of every file as lines of text."""
    return (
        f"SELECT asset_id, string_agg({text}, chr(10) ORDER BY {order}) AS t FROM "
        f"(SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY {order}) <= {AS_SHOWN.entries[cap]}) GROUP BY asset_id"
    )


FLOW_ORDER = "line, list_position([" + ", ".join(quote(p.name) for p in code.FLOW_PATTERNS) + "], name)"
METHOD = "CASE WHEN length(method) < 8 THEN rpad(method, 8, ' ') ELSE method END"


def _flows(kind: str) -> str:
    text = f"'  {kind.upper()} [' || category || '] ' || name || ' (line ' || line || '): ' || substr(context, 1, 100)"
    return listed(f"(SELECT * FROM flows WHERE type = '{kind}')", text, FLOW_ORDER, f"{kind}s")


def _counted(kinds: str) -> str:
    return f"(SELECT asset_id, count(*) AS n FROM facts WHERE kind IN ({kinds}) GROUP BY 1)"


EXTRACT_CTES = (
    "WITH " + findings_ctes(ALL_FILES_SQL) + _part(ENDPOINT_SQL) + _part(DEPS_SQL).replace("raw", "raw_deps") + _part(FLOW_SQL)
    + ", facts AS (" + " UNION ALL ".join(
        f"SELECT asset_id, '{k}' AS kind, {i} AS kind_no, line_no, pos, name, detail FROM ({FACT_SQL[k]})" for i, k in enumerate(KINDS)
    ) + ")\n"
)
BRIEFING_SQL = EXTRACT_CTES + f""", s1 AS ({listed('findings', "'  [' || severity || '] ' || description || ': ' || substr(evidence, 1, 80)", 'rule_id, line_number, pos', 'findings')}),
s2 AS ({listed('endpoints', f"'  ' || {METHOD} || ' ' || url || '  (via ' || context || ', line ' || line_no || ')'", 'line_no, ord, pos', 'endpoints')}),
s3 AS ({listed('judged', "'  ' || name || ' ' || version || ' [' || source || ']' || CASE WHEN vulnerable THEN ' ⚠ VULNERABLE (' || cve || ')' ELSE '' END", 'src, a, b', 'dependencies')}),
s4 AS ({_flows('sink')}), s5 AS ({_flows('source')}),
r AS ({listed("(SELECT * FROM facts WHERE kind IN ('route', 'file_route'))", "'    ' || detail || ' ' || name || ' (line ' || line_no || ')'", 'line_no, kind_no, pos', 'routes')}),
v AS ({listed("(SELECT * FROM facts WHERE kind = 'variable')", "'    ' || name || ' = ' || substr(detail, 1, 80) || ' (line ' || line_no || ')'", 'line_no, pos', 'variables')}),
f AS ({listed("(SELECT * FROM facts WHERE kind IN ('function', 'arrow'))", "name", 'line_no, kind_no, pos', 'functions').replace('chr(10)', "', '")}),
c AS ({listed("(SELECT * FROM facts WHERE kind = 'class')", "name", 'line_no, pos', 'classes').replace('chr(10)', "', '")}),
e AS (SELECT asset_id, string_agg(name, ', ' ORDER BY name) AS t FROM (SELECT DISTINCT asset_id, name FROM facts WHERE kind = 'event') GROUP BY 1),
s6 AS (SELECT a.asset_id, concat_ws(chr(10), '  Route definitions: ' || rn.n, r.t, '  Interesting variables: ' || vn.n, v.t,
  '  Functions: ' || fn.n || ' (' || f.t || ')', '  Classes: ' || c.t, '  Event listeners: ' || e.t) AS t
 FROM assets a LEFT JOIN r USING (asset_id) LEFT JOIN {_counted("'route', 'file_route'")} rn USING (asset_id) LEFT JOIN v USING (asset_id) LEFT JOIN {_counted("'variable'")} vn USING (asset_id)
 LEFT JOIN f USING (asset_id) LEFT JOIN {_counted("'function', 'arrow'")} fn USING (asset_id) LEFT JOIN c USING (asset_id) LEFT JOIN e USING (asset_id)
 WHERE coalesce(r.t, v.t, f.t, c.t) IS NOT NULL)
SELECT a.asset_id, a.url, coalesce(nullif(concat_ws(chr(10) || chr(10), 'REGEX FINDINGS:' || chr(10) || s1.t, 'ENDPOINTS EXTRACTED:' || chr(10) || s2.t,
 'DEPENDENCIES:' || chr(10) || s3.t, 'DANGEROUS SINKS:' || chr(10) || s4.t, 'USER-CONTROLLED SOURCES:' || chr(10) || s5.t, 'CODE STRUCTURE:' || chr(10) || s6.t), ''),
 '(No deterministic findings)') AS briefing
FROM assets a LEFT JOIN s1 USING (asset_id) LEFT JOIN s2 USING (asset_id) LEFT JOIN s3 USING (asset_id) LEFT JOIN s4 USING (asset_id) LEFT JOIN s5 USING (asset_id) LEFT JOIN s6 USING (asset_id)"""


@query("l1_briefings", BRIEFING_SQL)
def _(spark, sf_dir):
    return briefings(with_extracts(all_files(spark, sf_dir), limits=AS_SHOWN), limits=AS_SHOWN).select("asset_id", "url", "briefing")


@query(
    "audit_row_counts",
    EXTRACT_CTES + "SELECT 'findings' AS name, count(*) AS n FROM findings UNION ALL SELECT 'code_facts', count(*) FROM facts UNION ALL SELECT 'endpoints', count(*) FROM endpoints "
    "UNION ALL SELECT 'dependencies', count(*) FROM judged UNION ALL SELECT 'sinks_sources', count(*) FROM flows UNION ALL SELECT 'files', count(*) FROM assets",
)
def _(spark, sf_dir):
    """The whole audit: one pass over the text, written once, then the tables read from it.

    The derived files hold nothing that normalisation changes.
    """
    folder = f"{shared_folder(spark)}/extracts-{uuid.uuid4().hex}"
    extract(all_files(spark, sf_dir), AS_SHOWN).write.parquet(folder)
    result = tables(spark.read.parquet(folder))
    counts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in result.items() if name != "briefings"]
    merged = counts[0]
    for other in counts[1:]:
        merged = merged.unionByName(other)
    return merged
