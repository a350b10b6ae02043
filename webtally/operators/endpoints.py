"""API endpoint extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import code
from ..functions.patterns import LinePattern, anchored_matches
from ..functions.text import explode_structs, first_by_key, let, reshape, split_lines, strings

# context and pattern in order of precedence; groups: url, method (or second url).
# Anchors are looked up in the lower-cased text.
ENDPOINTS: list[tuple[str, LinePattern]] = [
    ("fetch", LinePattern(code.ENDPOINT_FETCH, (1, 2), (("fetch",),), ignore_case=True)),
    ("axios", LinePattern(code.ENDPOINT_AXIOS, (2, 1), (("ax",),), ignore_case=True)),
    ("axios_obj", LinePattern(code.ENDPOINT_AXIOS_OBJ, (1, 2), (("ax",), ("url",), ("method",)), ignore_case=True)),
    ("jquery", LinePattern(code.ENDPOINT_JQUERY, (1, 2), (("$.",),), ignore_case=True)),
    ("xhr", LinePattern(code.ENDPOINT_XHR, (2, 1), ((".open",),), ignore_case=True)),
    ("assignment", LinePattern(code.ENDPOINT_ASSIGNMENT, (1,), (("://", "/"),), ignore_case=True)),
    ("template", LinePattern(code.ENDPOINT_TEMPLATE, (1,), (("`",),))),
]
CONTEXTS = [context for context, _ in ENDPOINTS]


def endpoint_array(content: Column) -> Column:
    """``array<struct<line, method, url, context>>``; the first use of a URL in a file wins."""
    patterns = [p for _, p in ENDPOINTS]
    contexts = strings(CONTEXTS)

    def extract(lines: Column) -> Column:
        found = anchored_matches(patterns, content, 2)

        def shape(m: Column) -> Column:
            context = F.element_at(contexts, m.getField("id"))
            g1, g2 = m.getField("g1"), m.getField("g2")
            line_start = F.substring(F.lower(F.get(lines, m.getField("line") - 1)), 1, 50)
            method = (
                F.when(context == "fetch", F.upper(F.coalesce(g2, F.lit("GET"))))
                .when(context == "jquery", F.when(F.contains(line_start, F.lit("post")), F.lit("POST")).otherwise("GET"))
                .when(context.isin("assignment", "template"), F.lit("UNKNOWN"))
                .otherwise(F.upper(g2))
            )
            url = F.when(context == "jquery", F.coalesce(g1, g2)).otherwise(g1)
            return F.struct(
                url.alias("url"), m.getField("line").alias("line"), m.getField("id").alias("ord"),
                m.getField("pos").alias("pos"), method.alias("method"), context.alias("context"),
            )

        return F.transform(found, shape)

    found = let(split_lines(content), extract)
    kept = F.filter(
        found,
        lambda e: e.getField("url").isNotNull() & ~let(F.lower(e.getField("url")), lambda u: F.exists(strings(code.ENDPOINT_NOISE), lambda n: F.contains(u, n))),
    )
    firsts = first_by_key(kept, ["url"])
    return F.sort_array(reshape(firsts, "line", "ord", "pos", "method", "url", "context"))


def with_endpoints(assets: DataFrame) -> DataFrame:
    return assets.withColumn("_endpoints", endpoint_array(F.col("content")))


def endpoints(assets: DataFrame) -> DataFrame:
    """One row per file and endpoint URL, of any file type."""
    found = with_endpoints(assets.select("asset_id", "url", "content")).withColumnRenamed("url", "source_url")
    return explode_structs(found, "_endpoints", "asset_id", "source_url").drop("ord", "pos")


def endpoint_names(found: DataFrame) -> DataFrame:
    return found.select(F.concat_ws(" ", "method", "url").alias("endpoint"))


def endpoint_set(*named: DataFrame) -> DataFrame:
    """Distinct ``METHOD url`` of several sources, each with a column ``endpoint``."""
    merged = named[0].select("endpoint")
    for other in named[1:]:
        merged = merged.unionByName(other.select("endpoint"))
    return merged.distinct()
