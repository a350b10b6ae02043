"""Known vulnerable library versions."""

from __future__ import annotations

from typing import NamedTuple


class KnownVuln(NamedTuple):
    lib: str
    vuln_idx: int
    below: str
    cve: str
    descr: str


# Library, order within library, first fixed version, id, text.
KNOWN_VULNS: list[KnownVuln] = [
    KnownVuln("jquery", 0, "3.5.0", "CVE-2020-11022", "XSS via HTML sanitization"),
    KnownVuln("jquery", 1, "3.0.0", "CVE-2015-9251", "XSS in jQuery.htmlPrefilter"),
    KnownVuln("lodash", 0, "4.17.21", "CVE-2021-23337", "Command injection via template"),
    KnownVuln("lodash", 1, "4.17.12", "CVE-2019-10744", "Prototype pollution"),
    KnownVuln("angular", 0, "1.8.0", "Multiple", "Angular.js 1.x has multiple XSS vectors"),
    KnownVuln("angularjs", 0, "1.8.0", "Multiple", "Angular.js 1.x EOL, multiple XSS"),
    KnownVuln("moment", 0, "2.29.4", "CVE-2022-31129", "ReDoS in moment parsing"),
    KnownVuln("axios", 0, "1.6.0", "CVE-2023-45857", "CSRF token leakage"),
    KnownVuln("express", 0, "4.19.2", "CVE-2024-29041", "Open redirect"),
    KnownVuln("minimist", 0, "1.2.6", "CVE-2021-44906", "Prototype pollution"),
    KnownVuln("node-fetch", 0, "2.6.7", "CVE-2022-0235", "Header leak on redirect"),
    KnownVuln("handlebars", 0, "4.7.7", "CVE-2021-23369", "Prototype pollution RCE"),
    KnownVuln("dompurify", 0, "2.4.1", "CVE-2023-23631", "Mutation XSS bypass"),
    KnownVuln("marked", 0, "4.0.10", "CVE-2022-21680", "ReDoS"),
    KnownVuln("highlight.js", 0, "10.4.1", "CVE-2020-26237", "ReDoS / Prototype pollution"),
    KnownVuln("serialize-javascript", 0, "3.1.0", "CVE-2020-7660", "RCE via crafted input"),
    KnownVuln("postcss", 0, "8.4.31", "CVE-2023-44270", "Line return parsing error"),
]
