"""Code facts (C), endpoints (E), dependencies (P), data flow (K), normalisation (N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import code
from ..catalog.vulns import KNOWN_VULNS
from ..functions import normalize as N
from ..functions.dialect import WHITESPACE
from ..functions.text import strings
from ..functions.versions import version_below
from ..operators.dataflow import sink_source_summary, sinks_sources
from ..operators.dependencies import (
    corpus_dependencies, dependencies, load_manifests, match_vulns,
)
from ..operators.endpoints import CONTEXTS, endpoint_names, endpoint_set, endpoints
from ..operators.facts import KINDS, code_facts
from ..operators.normalization import normalize_content
from ..sources.assets import spread_small
from .corpus import (
    AS_SHOWN, CODE_SQL, LINES_SQL, MANIFEST_NAMES, MANIFEST_SPECS, code_files, manifest_files, quote, table,
)
from .oracle import all_matches, re2
from .registry import query


def strip_sql(text: str) -> str:
    return f"trim({text}, {quote(WHITESPACE)})"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_files(spark, sf_dir)


BASE_SQL = f"WITH assets AS ({CODE_SQL}), lines AS MATERIALIZED ({LINES_SQL})"

# -- code facts ----------------------------------------------------------------------

_SCRIPT_LINES = f"(SELECT * FROM lines WHERE file_type IN {in_list(code.SCRIPT_TYPES)})"


def _facts(pattern: str, groups: list[int], ignore_case: bool = False) -> str:
    return all_matches(_SCRIPT_LINES, "line", pattern, groups, "asset_id, line_no", ignore_case)


_VALUE = f"rtrim({strip_sql('g2')}, ';,')"
_IMPORTED = strip_sql("coalesce(nullif(g1, ''), g2)")
FACT_SQL: dict[str, str] = {
    "function": f"SELECT asset_id, line_no, pos, g1 AS name, {strip_sql('g2')} AS detail FROM ({_facts(code.FUNCTION_DECL, [1, 2])})",
    "arrow": f"SELECT asset_id, line_no, pos, g1 AS name, 'arrow' AS detail FROM ({_facts(code.FUNCTION_ARROW, [1])})",
    "class": f"SELECT asset_id, line_no, pos, g1 AS name, nullif(g2, '') AS detail FROM ({_facts(code.CLASS_DECL, [1, 2])})",
    "variable": f"SELECT asset_id, line_no, pos, g1 AS name, CASE WHEN length({_VALUE}) > 150 THEN substr({_VALUE}, 1, 150) || '...' ELSE {_VALUE} END AS detail "
    f"FROM ({_facts(code.VARIABLE, [1, 2])}) WHERE regexp_matches(g1, '{'|'.join(code.VARIABLE_KEYWORDS)}', 'i')",
    "es_import": f"SELECT asset_id, line_no, pos, g3 AS name, {_IMPORTED} AS detail FROM ({_facts(code.ES_IMPORT, [1, 2, 3])})",
    "require": f"SELECT asset_id, line_no, pos, g3 AS name, {_IMPORTED} AS detail FROM ({_facts(code.CJS_REQUIRE, [1, 2, 3])})",
    "export": f"SELECT asset_id, line_no, pos, g1 AS name, NULL::VARCHAR AS detail FROM ({_facts(code.EXPORT, [1])})",
    "route": f"SELECT asset_id, line_no, pos, g2 AS name, upper(g1) AS detail FROM ({_facts(code.SERVER_ROUTE, [1, 2], True)})",
    "file_route": f"SELECT asset_id, line_no, pos, g1 AS name, 'ANY' AS detail FROM ({_facts(code.FILE_ROUTE, [1])})",
    "event": f"SELECT asset_id, line_no, pos, g1 AS name, NULL::VARCHAR AS detail FROM ({_facts(code.EVENT_LISTENER, [1])})",
}
FACT_COLUMNS = "asset_id, '{kind}' AS kind, line_no AS line, pos, name, detail"
FACT_IDS = dict(zip(KINDS, ["c1_functions", "c2_arrow_functions", "c3_classes", "c4_variables", "c5_es_imports", "c6_requires",
                            "c7_exports", "c8_server_routes", "c9_file_routes", "c10_event_listeners"]))

for _kind, _name in FACT_IDS.items():

    @query(_name, f"{BASE_SQL} SELECT {FACT_COLUMNS.format(kind=_kind)} FROM ({FACT_SQL[_kind]})")
    def _(spark, sf_dir, kind=_kind):
        return code_facts(files(spark, sf_dir), AS_SHOWN).where(F.col("kind") == kind)


@query(
    "c11_code_facts",
    f"{BASE_SQL} " + " UNION ALL ".join(f"SELECT {FACT_COLUMNS.format(kind=k)} FROM ({FACT_SQL[k]})" for k in KINDS),
)
def _(spark, sf_dir):
    return code_facts(files(spark, sf_dir), AS_SHOWN)


# -- endpoints -----------------------------------------------------------------------

def _endpoints(pattern: str, groups: list[int], ignore_case: bool = True) -> str:
    return all_matches("lines", "line", pattern, groups, "asset_id, line_no, line", ignore_case)


def _endpoint(i: int, method: str, url: str, pattern: str, groups: list[int], ignore_case: bool = True) -> str:
    return (
        f"SELECT asset_id, line_no, {i} AS ord, pos, {method} AS method, {url} AS url, '{CONTEXTS[i - 1]}' AS context "
        f"FROM ({_endpoints(pattern, groups, ignore_case)})"
    )


ENDPOINT_SQL = f"""{BASE_SQL}, raw AS ({' UNION ALL '.join([
    _endpoint(1, "upper(coalesce(nullif(g2, ''), 'GET'))", "g1", code.ENDPOINT_FETCH, [1, 2]),
    _endpoint(2, "upper(g1)", "g2", code.ENDPOINT_AXIOS, [1, 2]),
    _endpoint(3, "upper(g2)", "g1", code.ENDPOINT_AXIOS_OBJ, [1, 2]),
    _endpoint(4, "CASE WHEN contains(substr(lower(line), 1, 50), 'post') THEN 'POST' ELSE 'GET' END", "coalesce(nullif(g1, ''), g2)", code.ENDPOINT_JQUERY, [1, 2]),
    _endpoint(5, "upper(g1)", "g2", code.ENDPOINT_XHR, [1, 2]),
    _endpoint(6, "'UNKNOWN'", "g1", code.ENDPOINT_ASSIGNMENT, [1]),
    _endpoint(7, "'UNKNOWN'", "g1", code.ENDPOINT_TEMPLATE, [1], False),
])}),
endpoints AS (SELECT * FROM raw WHERE url <> '' AND NOT ({' OR '.join(f"contains(lower(url), {quote(n)})" for n in code.ENDPOINT_NOISE)})
 QUALIFY row_number() OVER (PARTITION BY asset_id, url ORDER BY line_no, ord, pos) = 1)
"""


@query(
    "e1_e9_endpoints",
    ENDPOINT_SQL + "SELECT e.asset_id, a.url AS source_url, line_no AS line, method, e.url, context FROM endpoints e JOIN assets a USING (asset_id)",
)
def _(spark, sf_dir):
    return endpoints(files(spark, sf_dir))


for _i, _context in enumerate(CONTEXTS, 1):

    @query(f"e{_i}_{_context}_endpoints", ENDPOINT_SQL + f"SELECT asset_id, line_no AS line, method, url FROM endpoints WHERE context = '{_context}'")
    def _(spark, sf_dir, context=_context):
        return endpoints(files(spark, sf_dir)).where(F.col("context") == context).select("asset_id", "line", "method", "url")


@query("e10_endpoint_set", ENDPOINT_SQL + "SELECT DISTINCT method || ' ' || url AS endpoint FROM endpoints")
def _(spark, sf_dir):
    return endpoint_set(endpoint_names(endpoints(files(spark, sf_dir)))).orderBy("endpoint")


# -- dependencies ----------------------------------------------------------------------

def version_key_sql(version: str) -> str:
    bare = f"split_part(split_part(regexp_replace({version}, '^[v^~>=<]', ''), '-', 1), '+', 1)"
    return f"list_transform(list_slice(string_split({bare}, '.'), 1, 3), lambda p: TRY_CAST(p AS BIGINT))"


def version_below_sql(version: str, threshold: str) -> str:
    a, b = version_key_sql(version), version_key_sql(threshold)
    bad = lambda x: f"len(list_filter({x}, lambda p: p IS NULL)) > 0"
    return f"CASE WHEN {bad(a)} OR {bad(b)} THEN false ELSE {a} < {b} END"


KNOWN_SQL = "known(lib, vuln_idx, below, cve) AS (VALUES " + ", ".join(
    f"({quote(v.lib)}, {v.vuln_idx}, {quote(v.below)}, {quote(v.cve)})" for v in KNOWN_VULNS
) + ")"


def judged_sql(deps: str) -> str:
    """CTEs that add ``cve`` (NULL if none) to rows with a unique ``dep_id``."""
    norm = strip_sql("lower(name)")
    return f"""{KNOWN_SQL}, aliases AS (SELECT dep_id, version, unnest([{norm}, replace({norm}, '.js', ''), replace({norm}, 'js', '')]) AS alias,
 unnest([1, 2, 3]) AS alias_idx FROM {deps}),
matched AS (SELECT dep_id, arg_min(cve, alias_idx * 100 + vuln_idx) AS cve FROM aliases JOIN known ON lib = alias
 WHERE {version_below_sql('version', 'below')} GROUP BY dep_id)"""


ENTRIES_SQL = " UNION ALL ".join(
    f"SELECT c_custkey AS asset_id, {j} AS a, '{section}' AS section, ["
    + ", ".join(quote(n) for n in MANIFEST_NAMES) + f"][(c_custkey + {j}) % {len(MANIFEST_NAMES)} + 1] AS name, ["
    + ", ".join(quote(s) for s in MANIFEST_SPECS) + f"][(c_custkey * 3 + {j * 5}) % {len(MANIFEST_SPECS)} + 1] AS spec FROM customer WHERE c_custkey % 9 <> 8"
    for j, section in enumerate(["dependencies", "dependencies", "devDependencies", "peerDependencies", "peerDependencies"])
)
CLEAN_SPEC = r"split_part(regexp_replace(spec, '^[\^~>=<]+', ''), ' ', 1)"


@query("s4_load_manifests", f"SELECT asset_id, section, name, spec FROM ({ENTRIES_SQL})")
def _(spark, sf_dir):
    return load_manifests(manifest_files(spark, sf_dir))


@query(
    "p1_p8_manifest_dependencies",
    f"""WITH deps AS (SELECT *, row_number() OVER (ORDER BY asset_id, a) AS dep_id FROM (SELECT asset_id, a, name, {CLEAN_SPEC} AS version FROM ({ENTRIES_SQL}))
 QUALIFY row_number() OVER (PARTITION BY asset_id, lower(name), version ORDER BY a) = 1), {judged_sql('deps')}
SELECT asset_id, name, version, 'package.json' AS source, cve IS NOT NULL AS vulnerable, coalesce(cve, '') AS cve FROM deps LEFT JOIN matched USING (dep_id)""",
)
def _(spark, sf_dir):
    return dependencies(manifest_files(spark, sf_dir), limits=AS_SHOWN).select("asset_id", "name", "version", "source", "vulnerable", "cve")


def _deps(rows: str, text: str, pattern: str, src: int, i: int, ignore_case: bool = False) -> str:
    return f"SELECT asset_id, {src} AS src, {i} AS a, pos AS b, g1 AS name, g2 AS version FROM ({all_matches(rows, text, pattern, [1, 2], 'asset_id', ignore_case)})"


_PKG = "CASE WHEN starts_with(g1, '@') AND contains(g1, '/') THEN split_part(g1, '/', 1) || '/' || split_part(g1, '/', 2) ELSE split_part(g1, '/', 1) END"
DEPS_SQL = f"""{BASE_SQL}, raw AS ({' UNION ALL '.join(
    [_deps('assets', 'content', p, 2, i) for i, p in enumerate(code.DEPENDENCY_CDN, 1)]
    + [_deps('assets', 'content', code.DEPENDENCY_SCRIPT_NAME, 2, 5, True)]
    + [_deps('assets', f'substr(content, 1, {AS_SHOWN.banner})', p, 3, i) for i, p in enumerate(code.DEPENDENCY_BANNER, 1)]
    + [f"SELECT asset_id, 4, 1, pos, {_PKG}, 'unknown' FROM ({all_matches('assets', 'content', code.DEPENDENCY_IMPORT, [1], 'asset_id')})"]
)}),
deps AS MATERIALIZED (SELECT *, row_number() OVER () AS dep_id FROM (SELECT * FROM raw WHERE name <> '' AND NOT (src = 3 AND name = 'unknown')
 QUALIFY row_number() OVER (PARTITION BY asset_id, lower(name), version ORDER BY src, a, b) = 1)), {judged_sql('deps')},
judged AS (SELECT asset_id, src, a, b, name, version, ['package.json', 'cdn', 'inline_banner', 'import'][src] AS source,
 src < 4 AND cve IS NOT NULL AS vulnerable, CASE WHEN src < 4 THEN coalesce(cve, '') ELSE '' END AS cve FROM deps LEFT JOIN matched USING (dep_id))
"""


@query("p2_p8_code_dependencies", DEPS_SQL + "SELECT asset_id, name, version, source, vulnerable, cve FROM judged")
def _(spark, sf_dir):
    return dependencies(files(spark, sf_dir), limits=AS_SHOWN).select("asset_id", "name", "version", "source", "vulnerable", "cve")


for _id, _source in (("p2_p3_script_urls", "cdn"), ("p4_banners", "inline_banner"), ("p5_imports", "import")):

    @query(_id, DEPS_SQL + f"SELECT asset_id, name, version FROM judged WHERE source = '{_source}'")
    def _(spark, sf_dir, source=_source):
        return dependencies(files(spark, sf_dir), limits=AS_SHOWN).where(F.col("source") == source).select("asset_id", "name", "version")


# Bundles: the same files behind more text than the bound on banners.
_FILLER = "/* filler of a bundle, line by line */\n"
_BUNDLE_SQL = f"SELECT asset_id, url, file_type, repeat({quote(_FILLER[:-1])} || chr(10), 200) || content AS content FROM ({CODE_SQL})"
BUNDLE_DEPS_SQL = DEPS_SQL.replace(CODE_SQL, _BUNDLE_SQL, 1).replace(f"substr(content, 1, {AS_SHOWN.banner})", "content")


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_files(spark, sf_dir).withColumn("content", F.concat(F.repeat(F.lit(_FILLER), F.lit(200)), "content"))


@query("p2_p8_whole_bundles", BUNDLE_DEPS_SQL + "SELECT asset_id, name, version, source, vulnerable, cve FROM judged")
def _(spark, sf_dir):
    """Whole texts are searched: every banner stands behind 7,800 characters."""
    return dependencies(bundles(spark, sf_dir)).select("asset_id", "name", "version", "source", "vulnerable", "cve")


@query("p4_whole_banners", BUNDLE_DEPS_SQL + "SELECT asset_id, name, version FROM judged WHERE source = 'inline_banner'")
def _(spark, sf_dir):
    return dependencies(bundles(spark, sf_dir)).where("source = 'inline_banner'").select("asset_id", "name", "version")


@query(
    "p9_corpus_dependencies",
    DEPS_SQL + "SELECT name, version, source, vulnerable, cve FROM judged QUALIFY row_number() OVER (PARTITION BY lower(name), version ORDER BY asset_id, src, a, b) = 1",
)
def _(spark, sf_dir):
    return corpus_dependencies(dependencies(files(spark, sf_dir)))


_SPECS = "[" + ", ".join(quote(s) for s in MANIFEST_SPECS) + "]"


@query(
    "p7_version_below",
    f"""SELECT p_partkey AS id, version, threshold, {version_below_sql('version', 'threshold')} AS below FROM (SELECT p_partkey,
 {_SPECS}[p_partkey % {len(MANIFEST_SPECS)} + 1] AS version, (p_size % 5) || '.' || (p_partkey % 7) || '.' || (p_partkey % 3) AS threshold FROM part)""",
)
def _(spark, sf_dir):
    k = F.col("p_partkey")
    specs = strings(MANIFEST_SPECS)
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), F.element_at(specs, (k % len(MANIFEST_SPECS) + 1).cast("int")).alias("version"),
        F.concat_ws(".", F.col("p_size") % 5, k % 7, k % 3).alias("threshold"),
    )
    return rows.withColumn("below", version_below(F.col("version"), F.col("threshold")))


_LIBS = ["jquery", "jQuery.js", "angularjs", "AngularJS", "highlight.js", "highlight", "momentjs", "lodash", "node-fetch", "unknown"]
_LIBS_SQL = "[" + ", ".join(quote(s) for s in _LIBS) + "]"


@query(
    "p8_match_vulns",
    f"""WITH deps AS (SELECT l_orderkey * 10 + l_linenumber AS dep_id, {_LIBS_SQL}[l_partkey % {len(_LIBS)} + 1] AS name,
 (l_linenumber % 5) || '.' || (l_suppkey % 9) || '.' || (l_orderkey % 13) AS version FROM lineitem),
{judged_sql('(SELECT DISTINCT name, version, hash(name, version) AS dep_id FROM deps)')}
SELECT name, version, count(*) AS n, cve IS NOT NULL AS vulnerable, coalesce(cve, '') AS cve FROM deps d LEFT JOIN matched m ON hash(d.name, d.version) = m.dep_id GROUP BY ALL""",
)
def _(spark, sf_dir):
    libs = strings(_LIBS)
    deps = table(spark, sf_dir, "lineitem").select(
        F.element_at(libs, (F.col("l_partkey") % len(_LIBS) + 1).cast("int")).alias("name"),
        F.concat_ws(".", F.col("l_linenumber") % 5, F.col("l_suppkey") % 9, F.col("l_orderkey") % 13).alias("version"),
    )
    return match_vulns(deps.groupBy("name", "version").agg(F.count("*").alias("n")))


# -- data flow ---------------------------------------------------------------------------

def _flow(i: int, p: code.FlowPattern) -> str:
    hint = f"substr({strip_sql(f'regexp_extract(line, {re2(p.pattern)}, 1)')}, 1, 80)" if p.hint else "''"
    return (
        f"SELECT asset_id, line_no AS line, '{p.type}' AS type, '{p.category}' AS category, {quote(p.name)} AS name, "
        f"substr({strip_sql('line')}, 1, 200) AS context, {hint} AS data_flow_hint FROM code_lines WHERE regexp_matches(line, {re2(p.pattern)})"
    )


FLOW_SQL = f"""{BASE_SQL}, code_lines AS MATERIALIZED (SELECT * FROM lines WHERE file_type IN {in_list(code.DECODABLE_TYPES)}
 AND {strip_sql('line')} <> '' AND NOT starts_with({strip_sql('line')}, '//')),
flows AS ({' UNION ALL '.join(_flow(i, p) for i, p in enumerate(code.FLOW_PATTERNS, 1))})
"""


@query("k1_k25_sinks_sources", FLOW_SQL + "SELECT * FROM flows")
def _(spark, sf_dir):
    return sinks_sources(files(spark, sf_dir), AS_SHOWN)


@query("k26_sink_source_summary", FLOW_SQL + "SELECT asset_id, type, category, count(*) AS n FROM flows GROUP BY ALL")
def _(spark, sf_dir):
    return sink_source_summary(sinks_sources(files(spark, sf_dir), AS_SHOWN))


# -- normalisation: encode the rows of a table, decode them again ---------------------------

def _encoded(spark: SparkSession, sf_dir: str, content) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset_id"), F.lit("js").alias("file_type"), content.alias("content"))


def _escape(text, prefix: str):
    return F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", prefix.replace("\\", "\\\\") + "$1")


@query("n1_decode_hex", """SELECT c_custkey AS asset_id, 'x="' || c_name || '" \\x4 ' || c_mktsegment AS content FROM customer""")
def _(spark, sf_dir):
    text = F.concat(F.lit('x="'), _escape(F.col("c_name"), "\\x"), F.lit('" \\x4 '), "c_mktsegment")
    return _encoded(spark, sf_dir, text).select("asset_id", N.decode_hex(F.col("content")).alias("content"))


@query("n2_decode_unicode", """SELECT c_custkey AS asset_id, c_name || ' € 😀 ' || c_mktsegment || ' \\uD83D!' AS content FROM customer""")
def _(spark, sf_dir):
    text = F.concat(
        _escape(F.col("c_name"), "\\u00"), F.lit(" \\u20AC \\uD83D\\uDE00 "),
        F.regexp_replace(F.hex(F.encode("c_mktsegment", "UTF-8")), "(..)", "\\\\u{$1}"), F.lit(" \\uD83D!"),
    )
    return _encoded(spark, sf_dir, text).select("asset_id", N.decode_unicode(F.col("content")).alias("content"))


@query(
    "n3_decode_base64_literals",
    """SELECT c_custkey AS asset_id, 'a=/* b64decoded: */ "' || c_name || '"; b=atob("/////////w==")' AS content FROM customer""",
)
def _(spark, sf_dir):
    text = F.concat(F.lit('a=atob( "'), F.base64(F.encode("c_name", "UTF-8")), F.lit('" ); b=atob("/////////w==")'))
    return _encoded(spark, sf_dir, text).select("asset_id", N.decode_base64_literals(F.col("content")).alias("content"))


@query(
    "n4_join_string_literals",
    """SELECT c_custkey AS asset_id, 'u="' || c_name || '"; v=''a'' + "b"' AS content FROM customer""",
)
def _(spark, sf_dir):
    letters = F.regexp_replace("c_name", "(.)", '"$1" + ')
    text = F.concat(F.lit("u="), letters, F.lit('""; v=\'a\' + "b"'))
    return _encoded(spark, sf_dir, text).select("asset_id", N.join_string_literals(F.col("content")).alias("content"))


@query("n5_unescape_html", """SELECT doc_id AS asset_id, md5(text || ' <é&amp;') AS content_md5 FROM documents""")
def _(spark, sf_dir):
    text = F.concat(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit(" &lt;&eacute;&amp;amp;"))
    docs = spread_small(table(spark, sf_dir, "documents"))
    return docs.select(F.col("doc_id").alias("asset_id"), F.md5(N.unescape_html(text)).alias("content_md5"))


@query(
    "n6_normalize_content",
    """SELECT c_custkey AS asset_id, CASE c_custkey % 3 WHEN 0 THEN '"' || c_name || 'AB" /* b64decoded: */ "' || c_name || '" &amp;'
 WHEN 1 THEN '"' || c_name || 'AB" /* b64decoded: */ "' || c_name || '" &' ELSE '"' || c_name || '" + "\\x41\\u0042" atob("' || base64(c_name::BLOB) || '") &amp;' END AS content,
 ['js', 'html', 'css'][c_custkey % 3 + 1] AS file_type FROM customer""",
)
def _(spark, sf_dir):
    text = F.concat(
        F.lit('"'), "c_name", F.lit('" + "\\x41\\u0042" atob("'), F.base64(F.encode("c_name", "UTF-8")), F.lit('") &amp;')
    )
    kind = F.element_at(F.array(F.lit("js"), F.lit("html"), F.lit("css")), (F.col("asset_id") % 3 + 1).cast("int"))
    rows = _encoded(spark, sf_dir, text).withColumn("file_type", kind)
    return normalize_content(rows)


