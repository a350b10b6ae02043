"""Pieces of DuckDB SQL that restate patterns independently of the Spark plans."""

from __future__ import annotations

from ..catalog.rules import RULES
from ..functions.dialect import expand
from ..schema import SEVERITIES
from .corpus import LINES_SQL, quote

# RE2 has no lookahead. The first pattern's lookahead is implied by the word
# character after it; the second consumes what its lookahead inspects.
_WITHOUT_LOOKAHEAD = {
    "location.href/assign/replace with Variable": r"(location\.(?:href|assign|replace)\s*=\s*\w)",
    "jQuery html() with Variable": r"""(\.\$\(.*\)\.html\s*\()(?:[^'"]|['"][^<]|['"]?$)""",
}


def re2(pattern: str) -> str:
    return quote(expand(pattern, r"\b"))


def rank(column: str) -> str:
    cases = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES, 1))
    return f"CASE coalesce({column}, 'INFO') {cases} ELSE 6 END"


def all_matches(rows: str, text: str, pattern: str, groups: list[int], columns: str, ignore_case: bool = False) -> str:
    """One row per match with ``pos`` and ``g1 … gn``; a missing group is ''."""
    flag = ", 'i'" if ignore_case else ""
    lists = ", ".join(f"regexp_extract_all({text}, {re2(pattern)}, {g}{flag}) AS l{i}" for i, g in enumerate(groups, 1))
    outs = ", ".join(f"unnest(l{i}) AS g{i}" for i in range(1, len(groups) + 1))
    return f"SELECT {columns}, generate_subscripts(l1, 1) - 1 AS pos, {outs} FROM (SELECT *, {lists} FROM {rows})"


def findings_ctes(assets: str, prefix: str = "", severity: str = "r.severity", whole: bool = False) -> str:
    """CTEs ``assets, lines, hits, findings`` of a signature scan; the caller writes WITH.

    ``whole`` compares and shows all of the evidence, else the first 100 characters count and 300 are shown.
    """
    key, shown = ("g1", "g1") if whole else ("substr(g1, 1, 100)", "CASE WHEN length(g1) > 300 THEN substr(g1, 1, 300) || '...' ELSE g1 END")
    parts = []
    for i, rule in enumerate(RULES, 1):
        pattern = _WITHOUT_LOOKAHEAD.get(rule.name, rule.pattern)
        parts.append(all_matches(prefix + "lines", "line", pattern, [1], f"asset_id, {i}::BIGINT AS rule_id, line_no", ignore_case=True))
    rules = ", ".join(
        "(" + ", ".join([f"{i}::BIGINT", *[quote(x) for x in (r.name, r.severity, r.category, r.impact, r.recommendation)]]) + ")"
        for i, r in enumerate(RULES, 1)
    )
    p = prefix
    return f"""{p}assets AS ({assets}),
{p}lines AS MATERIALIZED ({LINES_SQL.replace('FROM assets', f'FROM {p}assets')}),
{p}rules(rule_id, name, severity, category, impact, recommendation) AS (VALUES {rules}),
{p}hits AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(parts)})
  QUALIFY row_number() OVER (PARTITION BY asset_id, rule_id, {key} ORDER BY line_no, pos) = 1),
{p}findings AS MATERIALIZED (SELECT h.asset_id, h.rule_id, {severity} AS severity, r.category, r.name || ' detected' AS description,
  {shown} AS evidence, r.impact, r.recommendation,
  a.url AS source_url, a.file_type, h.line_no AS line_number, 'signature' AS detector, h.pos, ({rank(severity)})::BIGINT AS severity_rank
  FROM {p}hits h JOIN {p}rules r USING (rule_id) JOIN {p}assets a USING (asset_id))
"""
