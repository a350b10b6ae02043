"""Patterns that describe code structure, endpoints, dependencies and data flow.

Written in Python regex syntax; ``functions.dialect`` translates them.
"""

from __future__ import annotations

from typing import NamedTuple

# File types treated as script code, and as decodable text.
SCRIPT_TYPES: list[str] = ["js", "mjs", "cjs", "jsx", "ts", "tsx"]
MARKUP_TYPES: list[str] = ["html", "htm"]
DECODABLE_TYPES: list[str] = SCRIPT_TYPES + MARKUP_TYPES

# Code structure patterns.
FUNCTION_DECL = r"""(?:^|\s)(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)"""
FUNCTION_ARROW = r"""(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|(\w+))\s*=>"""
CLASS_DECL = r"""class\s+(\w+)(?:\s+extends\s+(\w+))?\s*\{"""
VARIABLE = r"""(?:const|let|var)\s+(\w+)\s*=\s*(.{1,200})"""
VARIABLE_KEYWORDS = [
    "url",
    "api",
    "endpoint",
    "host",
    "server",
    "config",
    "secret",
    "key",
    "token",
    "password",
    "base",
    "auth",
    "header",
    "cookie",
    "route",
    "path",
    "port",
    "domain",
]
ES_IMPORT = r"""import\s+(?:\{([^}]+)\}|(\w+))\s+from\s+["']([^"']+)["']"""
CJS_REQUIRE = r"""(?:const|let|var)\s+(?:\{([^}]+)\}|(\w+))\s*=\s*require\s*\(\s*["']([^"']+)["']\s*\)"""
EXPORT = r"""export\s+(?:default\s+)?(?:const|let|var|function|class|async\s+function)\s+(\w+)"""
SERVER_ROUTE = r"""(?:app|router|server)\.(get|post|put|patch|delete|all|use)\s*\(\s*["']([^"']+)["']"""
FILE_ROUTE = r"""(?:pages|app)/api/([^\s"']+)"""
EVENT_LISTENER = r"""addEventListener\s*\(\s*["'](\w+)["']"""

# Endpoint patterns, in the order in which they claim a URL.
ENDPOINT_FETCH = r"""fetch\s*\(\s*["'`]([^"'`]+)["'`](?:\s*,\s*\{[^}]*method\s*:\s*["'](\w+)["'])?"""
ENDPOINT_AXIOS = r"""axios\.(\w+)\s*\(\s*["'`]([^"'`]+)["'`]"""
ENDPOINT_AXIOS_OBJ = r"""axios\s*\(\s*\{[^}]*url\s*:\s*["'`]([^"'`]+)["'`][^}]*method\s*:\s*["'`](\w+)["'`]"""
ENDPOINT_JQUERY = r"""\$\.(?:ajax|get|post|put|delete)\s*\(\s*(?:["'`]([^"'`]+)["'`]|\{[^}]*url\s*:\s*["'`]([^"'`]+)["'`])"""
ENDPOINT_XHR = r"""\.open\s*\(\s*["'](\w+)["']\s*,\s*["'`]([^"'`]+)["'`]"""
ENDPOINT_ASSIGNMENT = r"""(?:url|endpoint|path|api|href|action|src)\s*[=:]\s*["'`]((?:https?://|/)[^"'`\s]{5,})["'`]"""
ENDPOINT_TEMPLATE = r"""`((?:https?://|/api|/v[0-9])[^`]{5,})`"""
ENDPOINT_NOISE: list[str] = [
    ".css", ".png", ".jpg", ".gif", ".svg", ".ico", ".woff",
    "fonts.", "cdn.", "google-analytics", "googletagmanager",
    "facebook.", "twitter.", "linkedin.",
]

# Dependency patterns (name, version), in order of precedence.
DEPENDENCY_CDN: list[str] = [
    r"""cdnjs\.cloudflare\.com/ajax/libs/([^/]+)/([0-9][^/]+)/""",
    r"""unpkg\.com/([^@/]+)@([0-9][^/]+)""",
    r"""jsdelivr\.net/(?:npm|gh)/([^@/]+)@([0-9][^/]+)""",
    r"""googleapis\.com/ajax/libs/([^/]+)/([0-9][^/]+)""",
]
DEPENDENCY_SCRIPT_NAME = r"""(?:^|/)([a-z][\w.-]+?)[-.](\d+\.\d+(?:\.\d+)?(?:-[a-z0-9.]+)?)(?:\.min)?\.js"""
DEPENDENCY_BANNER: list[str] = [
    r"""[/*! ]+(\w[\w.-]+)\s+v?(\d+\.\d+(?:\.\d+)?)\s""",
    r"""\*\s+(\w+)\s+(\d+\.\d+\.\d+)""",
]
DEPENDENCY_IMPORT = r"""(?:from|require\s*\()\s*["']([^"'./][^"']*?)["']"""


class FlowPattern(NamedTuple):
    type: str
    category: str
    name: str
    pattern: str
    hint: bool


# Dangerous sinks and user-controlled sources, in report order.
FLOW_PATTERNS: list[FlowPattern] = [
    FlowPattern("sink", "xss", "innerHTML", r"""(\w+)\.innerHTML\s*[=+]""", True),
    FlowPattern("sink", "xss", "outerHTML", r"""(\w+)\.outerHTML\s*[=+]""", True),
    FlowPattern("sink", "xss", "document.write", r"""document\.write(?:ln)?\s*\((.{0,60})""", True),
    FlowPattern("sink", "eval", "eval", r"""(?:^|[^.\w])eval\s*\((.{0,60})""", True),
    FlowPattern("sink", "eval", "Function()", r"""(?:new\s+)?Function\s*\((.{0,60})""", True),
    FlowPattern("sink", "eval", "setTimeout/setInterval(string)", r"""(?:setTimeout|setInterval)\s*\(\s*["'`]""", False),
    FlowPattern("sink", "redirect", "location redirect", r"""location\.(?:href|assign|replace)\s*=\s*(.{0,60})""", True),
    FlowPattern("sink", "redirect", "window.open", r"""window\.open\s*\((.{0,60})""", True),
    FlowPattern("sink", "postmessage", "postMessage", r"""\.postMessage\s*\((.{0,60})""", True),
    FlowPattern("sink", "xss", "jQuery.html()", r"""\$\([^)]*\)\.html\s*\((.{0,60})""", True),
    FlowPattern("sink", "xss", "insertAdjacentHTML", r"""\.insertAdjacentHTML\s*\((.{0,60})""", True),
    FlowPattern("sink", "xss", "createElement(script)", r"""document\.createElement\s*\(\s*["']script["']""", False),
    FlowPattern("sink", "xss", "setAttribute(event/url)", r"""\.setAttribute\s*\(\s*["'](?:on\w+|href|src|action)["']\s*,\s*(.{0,60})""", True),
    FlowPattern("sink", "storage", "document.cookie set", r"""document\.cookie\s*=""", False),
    FlowPattern("sink", "storage", "Web Storage write", r"""(?:localStorage|sessionStorage)\.setItem\s*\((.{0,60})""", True),
    FlowPattern("sink", "misc", "execCommand", r"""\.execCommand\s*\(""", False),
    FlowPattern("source", "url", "URL parameters", r"""(?:location\.(?:search|hash|href|pathname)|window\.location)""", False),
    FlowPattern("source", "url", "document URL", r"""document\.(?:URL|documentURI|referrer|baseURI)""", False),
    FlowPattern("source", "url", "URL parsing", r"""(?:URLSearchParams|new\s+URL)\s*\(""", False),
    FlowPattern("source", "cookie", "document.cookie read", r"""document\.cookie(?:\s|[;,])""", False),
    FlowPattern("source", "storage", "Web Storage read", r"""(?:localStorage|sessionStorage)\.getItem""", False),
    FlowPattern("source", "postmessage", "postMessage listener", r"""addEventListener\s*\(\s*["']message["']""", False),
    FlowPattern("source", "dom", "DOM element value", r"""\.(?:value|innerText|textContent)\b""", False),
    FlowPattern("source", "form", "FormData", r"""(?:FormData|new\s+FormData)""", False),
    FlowPattern("source", "url", "query parameter", r"""(?:params|query|searchParams)\.get\s*\(""", False),
]

# Reference patterns in HTML and script text.
QUOTED_URL = r"""(?:["'`])((https?://[^\s"'`<>]+?|/[a-zA-Z0-9._\-/]+\.[a-zA-Z0-9]+))(?:["'`])"""
HTML_CHUNKS: list[str] = [
    r"""["']([a-zA-Z0-9._\-/]+\.chunk\.js)["']""",
    r"""["']([a-zA-Z0-9._\-/]+\.bundle\.js)["']""",
    r"""(?:src|href)\s*[=:]\s*["']?(/static/[^\s"'<>]+\.js)""",
    r"""["'](/(?:assets|chunks|js)/[^\s"'<>]+\.js)["']""",
]
SCRIPT_CHUNKS: list[str] = [
    r"""["']([a-zA-Z0-9._/\-]+\.chunk\.js)["']""",
    r"""["']([a-zA-Z0-9._/\-]+\.bundle\.js)["']""",
    r"""\.src\s*=\s*["'](/[^\s"']+\.js)["']""",
    r"""importScripts\s*\(\s*["']([^"']+)["']""",
]
NAVIGATION: list[str] = [
    r"""(?:href|to|path|route)\s*[=:]\s*["'](/[^"']+?)["']""",
    r"""(?:navigate|push|replace)\s*\(\s*["'](/[^"']+?)["']""",
    r"""(?:window\.location|location\.href)\s*=\s*["'](/[^"']+?)["']""",
]
