"""Briefings and prompts for a model (L1, L2). Running the model is not part of this.

Every section comes from an array in the file's own row, so a briefing needs
neither a join nor a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog.rules import RULES, Rule
from ..catalog.vulns import KNOWN_VULNS, KnownVuln
from ..functions.text import constant, cut, let
from ..limits import NONE, Limits
from .dataflow import with_flows
from .dependencies import with_dependencies
from .endpoints import with_endpoints
from .facts import with_facts
from .signatures import with_signature_hits

# Texts of a briefing.
TRUNCATED = "\n\n... [TRUNCATED] ..."
NOTHING_FOUND = "(No deterministic findings)"


def with_extracts(
    assets: DataFrame, rules: Sequence[Rule] = RULES, known: Sequence[KnownVuln] = KNOWN_VULNS,
    limits: Limits = NONE,
) -> DataFrame:
    """All extractions of a file as arrays in its row: one pass over the text."""
    hits = with_signature_hits(assets, rules, limits=limits)
    return with_flows(with_dependencies(with_endpoints(with_facts(hits, limits)), known, limits), limits)


def _section(title: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit(title + "\n"), F.array_join(lines, "\n")))


def _first(entries: Column, section: str, limits: Limits) -> Column:
    return F.slice(entries, 1, limits.entries[section]) if section in limits.entries else entries


def _of_kind(facts: Column, *kinds: str) -> Column:
    return F.filter(facts, lambda f: f.getField("kind").isin(*kinds))


def _structure(facts: Column, limits: Limits) -> Column:
    def number(line: Column) -> Column:
        return line.cast("string")

    def by_line(entries: Column) -> Column:
        return F.array_sort(
            entries,
            lambda a, b: F.when(a.getField("line") < b.getField("line"), -1).when(a.getField("line") > b.getField("line"), 1).otherwise(0),
        )

    def build(parts: Column) -> Column:
        routes, variables = parts.getField("routes"), parts.getField("variables")
        functions, classes = parts.getField("functions"), parts.getField("classes")
        events = parts.getField("events")
        names = lambda entries: F.transform(entries, lambda f: f.getField("name"))
        route_lines = F.transform(
            _first(routes, "routes", limits),
            lambda r: F.concat(F.lit("    "), r.getField("detail"), F.lit(" "), r.getField("name"),
                               F.lit(" (line "), number(r.getField("line")), F.lit(")")),
        )
        variable_lines = F.transform(
            _first(variables, "variables", limits),
            lambda v: F.concat(F.lit("    "), v.getField("name"), F.lit(" = "), cut(v.getField("detail"), limits.shown_value),
                               F.lit(" (line "), number(v.getField("line")), F.lit(")")),
        )
        heads = [
            (routes, F.concat(F.array(F.concat(F.lit("  Route definitions: "), F.size(routes))), route_lines)),
            (variables, F.concat(F.array(F.concat(F.lit("  Interesting variables: "), F.size(variables))), variable_lines)),
            (functions, F.array(F.concat(F.lit("  Functions: "), F.size(functions), F.lit(" ("),
                                         F.array_join(names(_first(functions, "functions", limits)), ", "), F.lit(")")))),
            (classes, F.array(F.concat(F.lit("  Classes: "), F.array_join(names(_first(classes, "classes", limits)), ", ")))),
            (events, F.array(F.concat(F.lit("  Event listeners: "),
                                      F.array_join(F.sort_array(F.array_distinct(names(events))), ", ")))),
        ]
        none = F.array().cast("array<string>")
        lines = F.concat(*[F.when(F.size(found) > 0, text).otherwise(none) for found, text in heads])
        shown = F.size(routes) + F.size(variables) + F.size(functions) + F.size(classes)
        return F.when(shown > 0, _section("CODE STRUCTURE:", lines))

    # functions are listed by line, declarations before arrows on the same line
    parts = F.struct(
        by_line(_of_kind(facts, "route", "file_route")).alias("routes"),
        _of_kind(facts, "variable").alias("variables"),
        by_line(_of_kind(facts, "function", "arrow")).alias("functions"),
        _of_kind(facts, "class").alias("classes"),
        _of_kind(facts, "event").alias("events"),
    )
    return let(parts, build)


def briefing(rules: Sequence[Rule] = RULES, limits: Limits = NONE) -> Column:
    """The briefing text over the arrays of ``with_extracts``."""
    attributes = constant([r._asdict() for r in rules], "array<struct<name: string, severity: string>>")

    def rule(h: Column, field: str) -> Column:
        return F.element_at(attributes, h.getField("rule_id")).getField(field)

    findings = F.transform(
        _first(F.col("_hits"), "findings", limits),
        lambda h: F.concat(F.lit("  ["), rule(h, "severity"), F.lit("] "), rule(h, "name"), F.lit(" detected: "),
                           cut(h.getField("evidence"), limits.shown_evidence)),
    )
    endpoints = F.transform(
        _first(F.col("_endpoints"), "endpoints", limits),
        lambda e: F.concat(
            F.lit("  "),
            F.when(F.length(e.getField("method")) < 8, F.rpad(e.getField("method"), 8, " ")).otherwise(e.getField("method")),
            F.lit(" "), e.getField("url"), F.lit("  (via "), e.getField("context"), F.lit(", line "),
            e.getField("line").cast("string"), F.lit(")")),
    )
    dependencies = F.transform(
        _first(F.col("_dependencies"), "dependencies", limits),
        lambda d: F.concat(
            F.lit("  "), d.getField("name"), F.lit(" "), d.getField("version"), F.lit(" ["), d.getField("source"), F.lit("]"),
            F.when(d.getField("vulnerable"), F.concat(F.lit(" ⚠ VULNERABLE ("), d.getField("cve"), F.lit(")"))).otherwise("")),
    )

    def flows(kind: str, cap: str) -> Column:
        chosen = F.filter(F.col("_flows"), lambda s: s.getField("type") == kind)
        return F.transform(
            _first(chosen, cap, limits),
            lambda s: F.concat(F.lit(f"  {kind.upper()} ["), s.getField("category"), F.lit("] "), s.getField("name"),
                               F.lit(" (line "), s.getField("line").cast("string"), F.lit("): "),
                               cut(s.getField("context"), limits.shown_context)),
        )

    sections = F.concat_ws(
        "\n\n",
        _section("REGEX FINDINGS:", findings),
        _section("ENDPOINTS EXTRACTED:", endpoints),
        _section("DEPENDENCIES:", dependencies),
        _section("DANGEROUS SINKS:", flows("sink", "sinks")),
        _section("USER-CONTROLLED SOURCES:", flows("source", "sources")),
        F.when(F.col("_facts").isNotNull(), _structure(F.col("_facts"), limits)),
    )
    return F.when(sections == "", F.lit(NOTHING_FOUND)).otherwise(sections)


def briefings(extracts: DataFrame, rules: Sequence[Rule] = RULES, limits: Limits = NONE) -> DataFrame:
    return extracts.withColumn("briefing", briefing(rules, limits))


def prompts(briefed: DataFrame, limits: Limits = NONE) -> DataFrame:
    """Prompt text per file: address, type, briefing, content, cut where a limit is given (L2).

    The frame around the values is a fixed format.
    """
    content = cut(F.col("content"), limits.content, TRUNCATED)
    text = F.concat(
        F.lit("File: "), "url", F.lit("\nType: "), "file_type",
        F.lit("\n\n═══ DETERMINISTIC BRIEFING ═══\n"), "briefing",
        F.lit("\n═══ END BRIEFING ═══\n\nFile content:\n```\n"), content, F.lit("\n```"),
    )
    return briefed.select("asset_id", "url", "file_type", text.alias("prompt"))
