"""Signature detection.

All rules run inside the row of their file: one Arrow function finds the matches in its lines, the first of equal ones only, so a
scan is one narrow projection. Nothing is shuffled, text never leaves its row, and the
same plan runs on a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..catalog.rules import RULES, Rule
from ..functions.patterns import LinePattern, first_matches
from ..functions.text import constant, cut, explode_structs
from ..limits import NONE, Limits
from ..schema import severity_rank

# Literals a text must contain, lower-cased, before a rule can match: one of
# each group. They follow from the patterns and only save work.
ANCHORS: dict[str, list[list[str]]] = {
    "AWS Access Key ID": [["akia"]],
    "AWS Secret Access Key": [["aws_secret", "secret_key", "secretaccesskey"]],
    "Google API Key": [["aiza"]],
    "Google OAuth Client Secret": [["gocspx-"]],
    "Firebase Config Exposed": [
        ["apikey", "authdomain", "databaseurl", "storagebucket", "messagingsenderid", "appid"]
    ],
    "Supabase Anon/Service Key": [["supabase"]],
    "GitHub Token": [["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]],
    "GitHub App Token": [["ghu_"]],
    "GitLab Token": [["glpat-"]],
    "Stripe Secret Key": [["sk_live_"]],
    "Stripe Publishable Key (live)": [["pk_live_"]],
    "Slack Bot/User Token": [["xox"]],
    "Slack Webhook URL": [["hooks.slack.com"]],
    "Twilio API Key": [["sk"]],
    "SendGrid API Key": [["sg."]],
    "Mailgun API Key": [["key-"]],
    "JSON Web Token": [["eyj"]],
    "Private Key (PEM)": [["private key-----"]],
    "Hardcoded Password": [["pass", "pwd"]],
    "Hardcoded Secret/Token": [["secret", "token", "api_key", "apikey"]],
    "Heroku API Key": [["heroku"]],
    "Azure Storage Account Key": [["accountkey", "account_key", "storage_key"]],
    "Shopify Access Token": [["shpat_"]],
    "Square Access Token": [["sq0atp-"]],
    "Telegram Bot Token": [[":aa"]],
    "Discord Bot Token": [["."]],
    "Credentials in URL": [["://"], ["@"]],
    "Internal IP Address (RFC 1918)": [["10.", "172.", "192.168."]],
    "Localhost / Loopback Reference": [["://localhost", "://127.0.0.1"]],
    "S3 Bucket URL": [["amazonaws.com"]],
    "S3 Bucket (path-style)": [["s3://"]],
    "GCS Bucket URL": [["storage.googleapis.com/"]],
    "Azure Blob Storage URL": [[".blob.core.windows.net"]],
    "Internal/Staging Hostname": [
        ["://"],
        [".internal.", ".local.", ".staging.", ".stage.", ".dev.", ".test.", ".qa.", ".uat.", ".preprod.", ".sandbox."],
    ],
    "GraphQL Endpoint": [["/graphql"]],
    "innerHTML Assignment": [[".innerhtml"]],
    "outerHTML Assignment": [[".outerhtml"]],
    "document.write": [["document.write"]],
    "eval() Usage": [["eval"]],
    "Function() Constructor": [["function"]],
    "setTimeout/setInterval with String": [["settimeout", "setinterval"]],
    "postMessage without Origin Check": [["addeventlistener"]],
    "postMessage to Wildcard": [[".postmessage"]],
    "location.href/assign/replace with Variable": [["location."]],
    "jQuery html() with Variable": [[".$("], [".html"]],
    "Prototype Pollution Gadget": [["__proto__", "constructor", "object.assign"]],
    "JSONP Callback": [["callback", "jsonp", "cb"], ["="]],
    "localStorage/sessionStorage Sensitive Data": [["localstorage.", "sessionstorage."]],
    "Source Map File": [["sourcemappingurl"]],
    "HTML/JS Comment with Sensitive Keyword": [["//", "/*", "<!--"]],
    "Debug Mode / Console Logging Sensitive Data": [["debug", "verbose"]],
    "Stack Trace / Error Path Disclosure": [
        [":\\", "/home/", "/var/", "/src/", "/app/", "/opt/", "/usr/"]
    ],
    "Email Address": [["@"]],
    "Version Comment / Header": [["v"], ["=", ":"]],
    "Webpack Chunk / Bundle Info": [["webpack"]],
    "Service Worker Registration": [["serviceworker"]],
    "CORS Wildcard": [["access-control-allow-origin"]],
    "CSP Unsafe-Inline/Eval": [["content-security-policy", "csp"], ["unsafe-inline", "unsafe-eval"]],
    "WebSocket Endpoint": [["ws://", "wss://"]],
    "Hardcoded API Base URL (Non-production)": [
        ["baseurl", "base_url", "apiurl", "api_url", "endpoint"], ["://"]
    ],
}


# rules that start with an unlimited repeat of a class
RUNS: dict[str, str] = {"Email Address": "[a-zA-Z0-9._%+-]"}

# rules that match at most once in a line, since the match reaches to the last end
# there is: where the first start in the line fails, no later one can match
FIRST_STARTS: dict[str, str] = {"jQuery html() with Variable": r"\.\$\("}


def rules_frame(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The catalogue as a table; rule_id is the position in the list, from 1."""
    rows = [
        (i, r.family, r.name, r.severity, r.category, r.impact, r.recommendation)
        for i, r in enumerate(rules, 1)
    ]
    return spark.createDataFrame(
        rows,
        "rule_id INT, family STRING, name STRING, severity STRING, category STRING, "
        "impact STRING, recommendation STRING",
    )


def _line_patterns(rules: Sequence[Rule], prefilter: bool) -> list[LinePattern]:
    def anchors(rule: Rule) -> tuple[tuple[str, ...], ...]:
        if not prefilter or rule not in RULES:
            return ()
        return tuple(tuple(group) for group in ANCHORS[rule.name])

    return [
        LinePattern(
            r.pattern, (1,), anchors(r), ignore_case=True, run=RUNS.get(r.name, "") if r in RULES else "",
            first=FIRST_STARTS.get(r.name, "") if r in RULES else "",
        )
        for r in rules
    ]


def signature_hits(
    content: Column, rules: Sequence[Rule] = RULES, prefilter: bool = True, limits: Limits = NONE
) -> Column:
    """De-duplicated matches of one file: ``array<struct<rule_id, line, pos, evidence>>``."""
    patterns = _line_patterns(rules, prefilter)
    hit = lambda m: F.struct(
        m.getField("id").alias("rule_id"), m.getField("line").alias("line"), m.getField("pos").alias("pos"),
        cut(m.getField("g1"), limits.evidence, "...").alias("evidence"),
    )
    return F.transform(first_matches(patterns, limits.key)(content), hit)


def with_signature_hits(
    assets: DataFrame, rules: Sequence[Rule] = RULES, prefilter: bool = True, limits: Limits = NONE
) -> DataFrame:
    return assets.withColumn("_hits", signature_hits(F.col("content"), rules, prefilter, limits))


def explode_hits(with_hits: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = ()) -> DataFrame:
    """Findings rows from the hit arrays, with the attributes of their rules and the
    columns of the file named in ``keep``."""
    attributes = constant(
        [r._asdict() for r in rules],
        "array<struct<name: string, severity: string, category: string, impact: string, recommendation: string>>",
    )
    rows = explode_structs(with_hits, "_hits", "asset_id", "url", "file_type", *keep)
    rule = F.element_at(attributes, F.col("rule_id"))
    return rows.select(
        "asset_id",
        "rule_id",
        rule.getField("severity").alias("severity"),
        rule.getField("category").alias("category"),
        F.concat(rule.getField("name"), F.lit(" detected")).alias("description"),
        "evidence",
        rule.getField("impact").alias("impact"),
        rule.getField("recommendation").alias("recommendation"),
        F.col("url").alias("source_url"),
        "file_type",
        F.col("line").alias("line_number"),
        F.lit("signature").alias("detector"),
        "pos",
        severity_rank(rule.getField("severity")).alias("severity_rank"),
        *keep,
    )


def scan_signatures(
    assets: DataFrame, rules: Sequence[Rule] = RULES, prefilter: bool = True, keep: Sequence[str] = (),
    limits: Limits = NONE,
) -> DataFrame:
    """All findings of all files. Reads ``asset_id, url, file_type, content`` and the
    columns in ``keep``, such as the target a file belongs to: carried along, they
    need no join later."""
    slim = assets.select("asset_id", "url", "file_type", "content", *keep)
    return explode_hits(with_signature_hits(slim, rules, prefilter, limits), rules, keep)
