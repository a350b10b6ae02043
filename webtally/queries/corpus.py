"""Web files derived from the benchmark tables, in Spark and in DuckDB SQL.

The given tables hold prose and simple pages, but no scripts. Each row of a base
table becomes one file: a few lines picked by the row's key from a list of line
forms, filled with values of the row. The corpus grows with its base table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import strings
from ..limits import Limits

# How much of each value results and briefings show.
AS_SHOWN = Limits(
    evidence=300, key=100, value=150, banner=5000, context=200, hint=80,
    entries={
        "findings": 20, "endpoints": 30, "dependencies": 20, "sinks": 20, "sources": 20,
        "routes": 10, "variables": 10, "functions": 15, "classes": 10,
    },
    shown_value=80, shown_evidence=80, shown_context=100, content=15000,
)

# placeholders: {k} key, {w} word of the row, {hN}/{HN} N hex digits of md5(key)
DIGITS = (4, 6, 8, 11, 12, 16, 22, 32)

_PEM = "-----BEGIN "

SIGNATURE_LINES: list[str] = [
    'aws = "AKIA{H16}";', 'aws = "AKIA{H16}Z9";', "akia{h16}",
    'aws_secret_access_key = "{h32}{h8}";', 'aws_secret = "{h32}";',
    'var g="AIza{h32}ABC";', 'var g="AIza{h32}";',
    'client_secret: "GOCSPX-{h32}"', 'client_secret: "GOCSPX-{h16}"',
    'apiKey: "{h32}", appId: "short",', 'databaseURL = "https://{k}.firebaseio.com"',
    'SUPABASE_ANON_KEY = "eyJ{h32}{h32}{h32}{h32}";', 'SUPABASE_ANON_KEY = "eyJ{h32}";',
    'x = "ghp_{h32}{h8}"', 'x = "ghx_{h32}{h8}"', "ghs_{h32}{h8},gho_{h32}{h8}",
    'y = "ghu_{h32}{h8}"', "z = glpat-{h32}", "z = glpat-{k}",
    's: "sk_live_{h32}"', 's: "pk_live_{h32}"', 's: "sk_test_{h32}"',
    "xoxb-{h32}", "xoxz-{h32}",
    'hook("https://hooks.slack.com/services/T{H16}/B{H16}/{h32}")', "https://hooks.slack.com/services/T1/B1/{h32}",
    'sid="SK{h32}"', 'sid="SK{h32}ab"', 'mail "SG.{h22}.{h32}{h11}"', 'mail "SG.{h16}.{h32}"',
    'mg = "key-{h32}"', 'mg = "key-{h16}"', "jwt: eyJ{h16}.eyJ{h16}.{h16}", "jwt: eyJ{h4}.eyJ{h4}.{h4}",
    _PEM + "EC PRIVATE KEY-----", _PEM + "PUBLIC KEY-----",
    'password = "{w}{k}"', 'pwd: "abc"', "PASSWD : '{h8}', pass='{w}-{k}'",
    'auth_token: "{h32}"', 'token: "short"', "api-secret = '{h16}'; access_token='{h22}'",
    "HEROKU_API_KEY={h8}-{h4}-{h4}-{h4}-{h12}", 'heroku my api main key: "{h8}-{h4}-{h4}-{h4}-{h12}"', "heroku key {h8}",
    "AccountKey={h32}{h32}{h22}==", "account_key={h32}",
    '"shpat_{h32}"', '"shpat_{h16}"', " sq0atp-{h22}", " sq0atp-{h8}",
    '"1234567890:AA{h32}b"', '"123:AA{h32}b"', '"MA{h32}.{h6}.{h32}"', '"MA{h8}.{h6}.{h32}"',
    "https://user{k}:pw{h8}@db.example.com/x", "https://user{k}@db.example.com/x",
    'ip = "10.1.2.3"; also (172.16.0.9) and 172.32.0.9', "route 192.168.1.1/24, 11.0.0.1", "v10.0.0.1x",
    "dev http://localhost:3000/x{k} http://127.0.0.1", "https://localhosting.example/",
    "https://bucket{k}.s3.us-east-1.amazonaws.com/a s3.amazonaws.com", "s3://bucket-{k}/path/x", "s3://x",
    "storage.googleapis.com/bkt-{k}/o", "https://acct{k}.blob.core.windows.net/c", "https://a.blob.core.windows.net/",
    "see https://api.staging.corp.com:8443/x{k}", "https://api.prod.corp.com/", "https://x{k}.io/graphql?q=1", "https://x{k}.io/graph",
    "el.innerHTML = {w}", "el.innerHTML == 1; el.outerHTML += x", "document.writeln ({w}); document.write(1)",
    "eval({w}); x.eval(1); my_eval(2)", "eval (atob(x))", "new Function ('return {k}')", "Function(a)",
    "setTimeout('go({k})', 1); setInterval(go, 2)", "window.addEventListener('message', on)", "addEventListener('msg', on)",
    "w.postMessage(data{k}, '*')", "w.postMessage(data, origin)",
    "location.href = target{k}", 'location.href = "/fixed"', "this.$('#a').html(v{k})", "this.$('#a').html('<b>{k}')",
    'o.__proto__ = 1; constructor["prototype"]', "Object.assign({}, req.body)", "Object.assign({}, local)",
    "url?callback=fn{k}&cb = x", "callback = 1", "localStorage.setItem('token', t)", "sessionStorage.getItem('theme')",
    "//# sourceMappingURL=app.{h8}.js.map", "//# sourceMappingURL=app.js", "// TODO fix {w} {k}", "/* FIXME: {w} */ x", "<!-- admin note {k} -->", "// plain note",
    "debug = true; verbose: 1", "debug: false", "at run (/home/app/srv/{w}/index.js:10:5)", "C:\\Users\\dev\\project{k}\\main.txt", "/tmp/x.js",
    "mail admin{k}@corp.example.com now", "no@mail", "version: 1.{k}.3", "ver = '2.0-beta.1'", "v=x",
    "__webpack_require__(12); webpackJsonp[1]", "webpack build", "navigator.serviceWorker.register('/sw{k}.js')", "serviceWorker off",
    "Access-Control-Allow-Origin: *", "Access-Control-Allow-Origin: https://a", "Content-Security-Policy: script-src 'unsafe-inline'", "CSP; unsafe-eval",
    "wss://live{k}.example.com/s", "ws:/broken", 'baseURL: "https://x.test.example/{k}"', 'api_url = "https://prod.example/"',
    "plain text without anything {w}", "",
    'token = "{h32}{h32}{h32}{h32}{h32}{h32}{h32}{h32}{h32}{h32}"',
]

CODE_LINES: list[str] = [
    "fetch('/api/orders/{k}')", 'fetch("/api/orders/{k}", { headers: h, method: "POST" })', "fetch(`/api/shared`)",
    "axios.get('/api/{w}')", "axios.create('/api/base')", "axios({ url: '/api/ax/{k}', method: 'put' })",
    "$.ajax({ type: t, url: '/jq/{k}' })", "$.post('/jq/post/{k}')", "$.get('/jq/get')",
    "                                                   $.get('/jq/late/{k}') // post",
    "xhr.open('DELETE', '/x/{k}')", "var apiUrl = 'https://api.example.com/v1/{k}';", "path: '/short'", "src = '/img/{k}.png'",
    "const t = `/api/v2/{w}/{k}`;", "const u = `/v3/items/${id}`", "url = 'https://cdn.example.com/lib.js'", "endpoint: '/api/shared'",
    "function load{k}(a, b) { return a }", " async function save ( x ) {", "const go = async (e) => e", "let f = x => x; var g=(a,b)=>a",
    "class View{k} extends Base {", "class Plain {", "const apiKey = makeKey({k});", "let count = {k}, total = 2",
    "const configBase = '{h32}{h32}{h32}{h32}{h32}';", "import { a, b } from 'lodash'", "import React from \"react\"", "import x from './local{k}'",
    "const { p } = require('path')", "const express = require( 'express' );", "var q = require('@scope/pkg/lib')", "export default class Main", "export const VALUE = {k}",
    "export async function run() {", "app.get('/users/{k}', h)", "router.POST ('/login', h)", "server.use(\"/static\", s)", "handler in pages/api/user/{k}",
    "el.addEventListener('click', f)", "addEventListener(\"message\", onMsg)", "// el.innerHTML = comment", "box{k}.innerHTML = html + box.innerHTML",
    "a.outerHTML += tail", "document.write('<p>' + location.hash)", "eval(userInput{k})", "new Function('a', body)", "setTimeout(\"run()\", 10)",
    "location.href = next{k}", "window.open(url{k}, '_blank')", "parent.postMessage({ k: {k} }, '*')", "$('#a').html(data{k})", "n.insertAdjacentHTML('x', t{k})",
    "document.createElement('script')", "img.setAttribute('onerror', code{k})", "document.cookie = 'a={k}'", "localStorage.setItem('k', v{k})", "document.execCommand('copy')",
    "var s = location.search; var r = document.referrer", "new URL(window.location)", "const c = document.cookie;", "sessionStorage.getItem('u')", "v = input.value + node.textContent",
    "new FormData(form)", "params.get('q{k}')", "   ", "plain();\tvalues.x", "\t//  spaced comment eval(x)",
    "src=\"https://cdnjs.cloudflare.com/ajax/libs/jquery/3.4.{k}/jquery.min.js\"", "https://unpkg.com/react@17.0.2/umd/react.js", "https://cdn.jsdelivr.net/npm/lodash@4.17.15/lodash.min.js",
    "https://ajax.googleapis.com/ajax/libs/angularjs/1.7.9/angular.min.js", "/static/moment-2.29.1.min.js", "/js/vendor.axios-0.21.0.js?x", "/js/Highlight.js-10.4.0.js",
    "/*! jQuery v3.6.0 | (c) */", " * Lodash 4.17.20 build", "/* handlebars v4.7.6 */ x", "* unknown 1.2.3 ",
]

MANIFEST_SPECS: list[str] = [
    "^1.2.3", "~4.17.20", ">=1.0 <2", "v1.2", "3.5", "3.5.0", "1.x", "1.2.3-beta", "2.29.3+build", "latest", "=8.4.30", "<=0.9", "10.4", "4.0.9", "", "1.6.0",
]
MANIFEST_NAMES: list[str] = [
    "jquery", "lodash", "moment.js", "jquery.js", "AngularJS", "axios", "express", "@scope/pkg", "postcss", "marked", "highlight.js", "node-fetch", "left-pad",
]

FILE_TYPES: list[str] = ["js", "ts", "html", "mjs", "json", "css", "jsx", "txt"]


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- filling a line form ---------------------------------------------------------

def _fill(form: Column, key: Column, word: Column, digest: Column, capitals: Column) -> Column:
    out = F.replace(F.replace(form, F.lit("{k}"), key), F.lit("{w}"), word)
    for n in DIGITS:
        out = F.replace(out, F.lit(f"{{h{n}}}"), F.substring(digest, 1, n))
        out = F.replace(out, F.lit(f"{{H{n}}}"), F.substring(capitals, 1, n))
    return out


def _fill_sql(form: str, key: str, word: str) -> str:
    out = f"replace(replace({form}, '{{k}}', {key}::VARCHAR), '{{w}}', {word})"
    for n in DIGITS:
        out = f"replace({out}, '{{h{n}}}', substr(md5({key}::VARCHAR), 1, {n}))"
        out = f"replace({out}, '{{H{n}}}', upper(substr(md5({key}::VARCHAR), 1, {n})))"
    return out


#: Rows of a base table that one task fills into files.
SPREAD_ROWS = 25_000


def spread_rows(base: DataFrame) -> DataFrame:
    """The rows of a base table over all cores, in more tasks if it is large.

    Moved while they are a key and a word, before they become files of hundreds or thousands of characters: the few
    splits of a small stored table would else do all the work on them. Rows are counted, which reads no more than the
    footers of the files: their bytes as stored say little of the bytes that the files will have.
    """
    return base.repartition(max(base.sparkSession.sparkContext.defaultParallelism, math.ceil(base.count() / SPREAD_ROWS)))


def derived_files(base: DataFrame, key: str, word: str, forms: list[str], n_lines: int, stride: int) -> DataFrame:
    """Assets of ``n_lines`` lines per row of the base table."""
    k = F.col(key).cast("bigint")
    table = strings(forms)
    rows = spread_rows(base.select(k.alias("asset_id"), F.col(word).alias("_w")))
    staged = rows.withColumn("_md5", F.md5(F.col("asset_id").cast("string")))
    picked = F.transform(
        F.sequence(F.lit(0), F.lit(n_lines - 1)),
        lambda j: F.element_at(table, ((F.col("asset_id") * n_lines + j * stride) % len(forms) + 1).cast("int")),
    )
    # joined first and filled once: the forms of a file are one text
    staged = staged.withColumns({"_form": F.array_join(picked, "\n"), "_capitals": F.upper("_md5")})
    content = _fill(F.col("_form"), F.col("asset_id").cast("string"), F.col("_w"), F.col("_md5"), F.col("_capitals"))
    file_type = F.element_at(
        strings(FILE_TYPES), (F.col("asset_id") % len(FILE_TYPES) + 1).cast("int")
    )
    return staged.select(
        "asset_id",
        F.concat(F.lit("https://s"), F.col("asset_id") % 50, F.lit(".example.com/static/app-"), "asset_id", F.lit("."), file_type).alias("url"),
        file_type.alias("file_type"),
        content.alias("content"),
    )


def derived_files_sql(base: str, key: str, word: str, forms: list[str], n_lines: int, stride: int) -> str:
    k = f"{key}::BIGINT"
    forms_sql = "[" + ", ".join(quote(f) for f in forms) + "]"
    types_sql = "[" + ", ".join(quote(t) for t in FILE_TYPES) + "]"
    form = (
        f"array_to_string(list_transform(range({n_lines}), lambda j: {forms_sql}"
        f"[(({k}) * {n_lines} + j * {stride}) % {len(forms)} + 1]), chr(10))"
    )
    file_type = f"{types_sql}[({k}) % {len(FILE_TYPES)} + 1]"
    filled = _fill_sql("_form", "asset_id", "_w")
    return (
        f"SELECT asset_id, 'https://s' || (asset_id % 50) || '.example.com/static/app-' || asset_id || '.' || file_type AS url, "
        f"file_type, {filled} AS content FROM (SELECT {k} AS asset_id, {word} AS _w, {form} AS _form, {file_type} AS file_type FROM {base})"
    )


# -- the corpora -------------------------------------------------------------------

def leaky_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with positives and near misses of every signature rule, from ``part``."""
    return derived_files(table(spark, sf_dir, "part"), "p_partkey", "p_name", SIGNATURE_LINES, 10, 13)


LEAKY_SQL = derived_files_sql("part", "p_partkey", "p_name", SIGNATURE_LINES, 10, 13)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts with endpoints, facts, dependencies, sinks and sources, from ``customer``."""
    return derived_files(table(spark, sf_dir, "customer"), "c_custkey", "c_name", CODE_LINES, 12, 7)


CODE_SQL = derived_files_sql("customer", "c_custkey", "c_name", CODE_LINES, 12, 7)


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package manifests as JSON text, from ``customer``; every ninth is malformed."""
    k = F.col("c_custkey").cast("bigint")
    specs, names = strings(MANIFEST_SPECS), strings(MANIFEST_NAMES)

    def pair(j: int) -> Column:
        name = F.element_at(names, ((k + j) % len(MANIFEST_NAMES) + 1).cast("int"))
        spec = F.element_at(specs, ((k * 3 + j * 5) % len(MANIFEST_SPECS) + 1).cast("int"))
        return F.concat(F.lit('"'), name, F.lit('": "'), spec, F.lit('"'))

    content = F.concat(
        F.lit('{"name": "app", "dependencies": {'), pair(0), F.lit(", "), pair(1),
        F.lit('}, "devDependencies": {'), pair(2), F.lit('}, "peerDependencies": {'), pair(3), F.lit(", "), pair(4),
        F.when(k % 9 == 8, F.lit("}")).otherwise("}}"),
    )
    return spread_rows(table(spark, sf_dir, "customer").select("c_custkey")).select(
        k.alias("asset_id"), F.concat(F.lit("https://m.example.com/"), k, F.lit("/package.json")).alias("url"),
        F.lit("json").alias("file_type"), content.alias("content"),
    )


def _manifest_pair(j: int) -> str:
    names = "[" + ", ".join(quote(n) for n in MANIFEST_NAMES) + "]"
    specs = "[" + ", ".join(quote(s) for s in MANIFEST_SPECS) + "]"
    k = "c_custkey::BIGINT"
    return f"""'"' || {names}[({k} + {j}) % {len(MANIFEST_NAMES)} + 1] || '": "' || {specs}[({k} * 3 + {j * 5}) % {len(MANIFEST_SPECS)} + 1] || '"'"""


MANIFEST_SQL = f"""SELECT c_custkey::BIGINT AS asset_id, 'https://m.example.com/' || c_custkey || '/package.json' AS url, 'json' AS file_type,
'{{"name": "app", "dependencies": {{' || {_manifest_pair(0)} || ', ' || {_manifest_pair(1)} || '}}, "devDependencies": {{' || {_manifest_pair(2)}
|| '}}, "peerDependencies": {{' || {_manifest_pair(3)} || ', ' || {_manifest_pair(4)} || CASE WHEN c_custkey % 9 = 8 THEN '}}' ELSE '}}}}' END AS content FROM customer"""

LINES_SQL = (
    "SELECT asset_id, file_type, unnest(string_split(content, chr(10))) AS line, "
    "generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM assets"
)
