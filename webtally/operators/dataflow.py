"""Dangerous sinks and user-controlled sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import code
from ..functions import dialect
from ..functions.text import constant, cut, explode_structs, let, split_lines, strip
from ..limits import NONE, Limits

# Literals that must occur in the file, and in the line, for a pattern to match; they only save work.
ANCHORS: dict[str, list[str]] = {
    "innerHTML": [".innerHTML"],
    "outerHTML": [".outerHTML"],
    "document.write": ["document.write"],
    "eval": ["eval"],
    "Function()": ["Function"],
    "setTimeout/setInterval(string)": ["setTimeout", "setInterval"],
    "location redirect": ["location."],
    "window.open": ["window.open"],
    "postMessage": [".postMessage"],
    "jQuery.html()": [".html"],
    "insertAdjacentHTML": [".insertAdjacentHTML"],
    "createElement(script)": ["document.createElement"],
    "setAttribute(event/url)": [".setAttribute"],
    "document.cookie set": ["document.cookie"],
    "Web Storage write": ["Storage.setItem"],
    "execCommand": [".execCommand"],
    "URL parameters": ["location"],
    "document URL": ["document."],
    "URL parsing": ["URL"],
    "document.cookie read": ["document.cookie"],
    "Web Storage read": ["Storage.getItem"],
    "postMessage listener": ["addEventListener"],
    "DOM element value": [".value", ".innerText", ".textContent"],
    "FormData": ["FormData"],
    "query parameter": [".get"],
}


def flow_array(content: Column, limits: Limits = NONE) -> Column:
    """``array<struct<line, ord, type, category, name, context, data_flow_hint>>``.

    The first match of each pattern per line counts; blank and comment lines do not.
    """
    rows = [
        {
            "ord": i, "rx": dialect.java(p.pattern), "hint": 1 if p.hint else 0, "anchors": ANCHORS[p.name],
            "type": p.type, "category": p.category, "name": p.name,
        }
        for i, p in enumerate(code.FLOW_PATTERNS, 1)
    ]
    table = constant(
        rows,
        "array<struct<ord: int, rx: string, hint: int, anchors: array<string>, type: string, category: string, name: string>>",
    )
    active = F.filter(
        table, lambda p: F.exists(p.getField("anchors"), lambda a: F.contains(content, a))
    )

    def numbered(line: Column, i: Column) -> Column:
        return F.struct((i + 1).alias("line"), line.alias("text"), strip(line).alias("stripped"))

    code_lines = F.filter(
        F.transform(split_lines(content), numbered),
        lambda x: (x.getField("stripped") != "") & ~x.getField("stripped").startswith("//"),
    )

    def on_pattern(p: Column, lines: Column) -> Column:
        def found(text: Column) -> Column:
            return F.exists(p.getField("anchors"), lambda a: F.contains(text, a)) & F.rlike(text, p.getField("rx"))

        hits = F.filter(lines, lambda x: found(x.getField("text")))
        return F.transform(
            hits,
            lambda x: F.struct(
                x.getField("line").alias("line"), p.getField("ord").alias("ord"), p.getField("type").alias("type"),
                p.getField("category").alias("category"), p.getField("name").alias("name"),
                cut(x.getField("stripped"), limits.context).alias("context"),
                F.when(
                    p.getField("hint") == 1,
                    cut(
                        strip(F.get(F.regexp_extract_all(x.getField("text"), p.getField("rx"), F.lit(1)), F.lit(0))), limits.hint
                    ),
                ).otherwise("").alias("data_flow_hint"),
            ),
        )

    found = let(code_lines, lambda lines: F.flatten(F.transform(active, lambda p: on_pattern(p, lines))))
    return F.sort_array(found)


def with_flows(assets: DataFrame, limits: Limits = NONE) -> DataFrame:
    relevant = F.col("file_type").isin(code.DECODABLE_TYPES)
    return assets.withColumn("_flows", F.when(relevant, flow_array(F.col("content"), limits)))


def sinks_sources(assets: DataFrame, limits: Limits = NONE) -> DataFrame:
    """One row per pattern and line of script and markup files."""
    relevant = assets.where(F.col("file_type").isin(code.DECODABLE_TYPES)).select("asset_id", "file_type", "content")
    return explode_structs(with_flows(relevant, limits), "_flows", "asset_id").drop("ord")


def sink_source_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("asset_id", "type", "category").agg(F.count("*").alias("n"))
