"""Code structure facts of script files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import code
from ..functions.patterns import LinePattern, anchored_matches
from ..functions.text import cut, explode_structs, strings, strip
from ..limits import NONE, Limits

# kind and pattern, in report order; anchors are looked up in the lower-cased text
FACTS: list[tuple[str, LinePattern]] = [
    ("function", LinePattern(code.FUNCTION_DECL, (1, 2), (("function",),))),
    ("arrow", LinePattern(code.FUNCTION_ARROW, (1,), (("=>",),))),
    ("class", LinePattern(code.CLASS_DECL, (1, 2), (("class",),))),
    ("variable", LinePattern(code.VARIABLE, (1, 2), (("const", "let", "var"),))),
    ("es_import", LinePattern(code.ES_IMPORT, (1, 2, 3), (("import",),))),
    ("require", LinePattern(code.CJS_REQUIRE, (1, 2, 3), (("require",),))),
    ("export", LinePattern(code.EXPORT, (1,), (("export",),))),
    ("route", LinePattern(
        code.SERVER_ROUTE, (1, 2), ((".get", ".po", ".put", ".patch", ".delete", ".all", ".u"),), ignore_case=True)),
    ("file_route", LinePattern(code.FILE_ROUTE, (1,), (("/api/",),))),
    ("event", LinePattern(code.EVENT_LISTENER, (1,), (("addeventlistener",),))),
]
KINDS = [kind for kind, _ in FACTS]


def fact_array(content: Column, limits: Limits = NONE) -> Column:
    """``array<struct<kind, line, pos, name, detail>>`` of one script file."""
    patterns = [p for _, p in FACTS]
    found = anchored_matches(patterns, content, 3)
    kinds = strings(KINDS)
    keyword = "(?i)" + "|".join(code.VARIABLE_KEYWORDS)

    def shape(m: Column) -> Column:
        kind = F.element_at(kinds, m.getField("id"))
        g1, g2, g3 = (m.getField(f"g{k}") for k in (1, 2, 3))
        value = F.rtrim(strip(F.coalesce(g2, F.lit(""))), F.lit(";,"))
        value = cut(value, limits.value, "...")
        is_import = kind.isin("es_import", "require")
        name = (
            F.when(is_import, g3)
            .when(kind == "route", g2)
            .otherwise(g1)
        )
        detail = (
            F.when(kind == "function", strip(F.coalesce(g2, F.lit(""))))
            .when(kind == "arrow", F.lit("arrow"))
            .when(kind == "class", g2)
            .when(kind == "variable", value)
            .when(is_import, strip(F.coalesce(g1, g2, F.lit(""))))
            .when(kind == "route", F.upper(g1))
            .when(kind == "file_route", F.lit("ANY"))
        )
        return F.struct(
            kind.alias("kind"), m.getField("line").alias("line"), m.getField("pos").alias("pos"),
            name.alias("name"), detail.alias("detail"),
        )

    facts = F.transform(found, shape)
    return F.filter(facts, lambda f: (f.getField("kind") != "variable") | f.getField("name").rlike(keyword))


def with_facts(assets: DataFrame, limits: Limits = NONE) -> DataFrame:
    script = F.col("file_type").isin(code.SCRIPT_TYPES)
    return assets.withColumn("_facts", F.when(script, fact_array(F.col("content"), limits)))


def code_facts(assets: DataFrame, limits: Limits = NONE) -> DataFrame:
    """One row per fact. ``detail`` holds parameters, base class, value, imported
    names or HTTP method, depending on ``kind``."""
    script = assets.where(F.col("file_type").isin(code.SCRIPT_TYPES)).select("asset_id", "file_type", "content")
    return explode_structs(with_facts(script, limits), "_facts", "asset_id")
