"""Large single files are read in time that grows with their length, and nothing is cut by default."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from webtally.catalog.rules import RULES
from webtally.functions.normalize import join_string_literals
from webtally.limits import Limits
from webtally.operators.dataflow import sinks_sources
from webtally.operators.dependencies import dependencies
from webtally.operators.discovery import spa_flag
from webtally.operators.facts import code_facts
from webtally.operators.findings import dedupe_findings
from webtally.operators.signatures import scan_signatures

MB = 1 << 20


def asset(spark, content: str, kind: str = "js"):
    return spark.createDataFrame([(1, "u", kind, content)], "asset_id BIGINT, url STRING, file_type STRING, content STRING")


def seconds(action, warm_up=None) -> tuple[float, list]:
    """Time of the second run only, if there is a small one first to start the Python workers."""
    if warm_up is not None:
        warm_up().collect()
    start = time.perf_counter()
    rows = action().collect()
    return time.perf_counter() - start, rows


def test_long_list_without_end_tags(spark):
    html = "<html><body><div id='root'>" + "<li>item" * (2 * MB // 8) + "</div></body></html>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id BIGINT, url STRING, html STRING")
    small = spark.createDataFrame([(1, "u", "<body></body>")], pages.schema)
    took, rows = seconds(lambda: spa_flag(pages), lambda: spa_flag(small))
    assert rows[0].body_chars == 4 * (2 * MB // 8) and not rows[0].is_spa
    assert took < 10


def test_long_chain_of_mixed_quotes(spark):
    text = """'a' + "b", """ * (2 * MB // 11)
    took, rows = seconds(lambda: asset(spark, text).select(F.md5(join_string_literals(F.col("content"))) == F.md5("content")))
    assert rows[0][0] and took < 10


RULE = next(r for r in RULES if r.name == "jQuery html() with Variable")


@pytest.mark.parametrize(
    "line",
    [
        "x.$(a).html(b)", "x.$(a).html('<b>')", "x.$(a).html(b); y.$(c).html(d)", "x.$(a).html(b); y.$(c).html('<d>')",
        "x.$(a).html('<b>'); y.$(c).html(d) z.$(", ".$(.$(.$()).html ( 'x')", ".$().html(", "$(a).html(b)", ".$(a", "",
    ],
)
def test_start_of_the_only_match(spark, line):
    want = [m.group("match") for m in re.finditer(RULE.pattern, line, re.IGNORECASE)]
    assert [r.evidence for r in scan_signatures(asset(spark, line), [RULE]).collect()] == want


def test_bundle_on_one_line(spark):
    bundle = "a.$(b).html('<i>');" * (2 * MB // 19)
    took, rows = seconds(lambda: scan_signatures(asset(spark, bundle), [RULE]))
    assert rows == [] and took < 10


def test_nothing_is_cut_unless_asked_for(spark):
    first, second = "a" * 300 + "1", "a" * 300 + "2"
    text = f'x = "{first}";\ny = "{second}";\n' + "//" + "-" * 6000 + "\n/* jquery v3.1.0 */\n"
    rule = RULE._replace(pattern=r'(?P<match>"a+[12]")')
    assert [len(r.evidence) for r in scan_signatures(asset(spark, text), [rule]).collect()] == [303, 303]
    cut = scan_signatures(asset(spark, text), [rule], limits=Limits(evidence=200, key=100)).collect()
    assert [r.evidence for r in cut] == ['"' + "a" * 199 + "..."]
    assert dependencies(asset(spark, text)).where("source = 'inline_banner'").count() >= 1
    assert dependencies(asset(spark, text), limits=Limits(banner=5000)).where("name = 'jquery'").count() == 0
    found = scan_signatures(asset(spark, text), [rule]).withColumn("line_number", F.lit(1))
    assert dedupe_findings(found).count() == 2 and dedupe_findings(found, key_chars=100).count() == 1
    long = "const apiKey = " + "v" * 400 + ";\nel.innerHTML = " + "w" * 400
    # the pattern itself reads 200 characters of a value
    assert max(len(r.detail) for r in code_facts(asset(spark, long)).collect()) == 200
    assert max(len(r.detail) for r in code_facts(asset(spark, long), Limits(value=150)).collect()) == 153
    assert max(len(r.context) for r in sinks_sources(asset(spark, long)).collect()) == 415
