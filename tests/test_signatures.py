"""The signature scan against a plain Python restatement of its rules."""

import re

import pytest
from pyspark.sql import functions as F

from webtally.catalog.rules import RULES, Rule
from webtally.functions import patterns as matching
from webtally.functions.patterns import LinePattern, active_patterns, pattern_matches
from webtally.functions.text import let
from webtally.operators.signatures import ANCHORS, scan_signatures
from webtally.queries.corpus import AS_SHOWN, SIGNATURE_LINES

COMPILED = [(re.compile(r.pattern, re.IGNORECASE | re.MULTILINE), r) for r in RULES]
COLUMNS = ["asset_id", "rule_id", "line_number", "evidence"]


def brute_force(asset_id, content, rules=COMPILED):
    seen, out = set(), []
    for rule_id, (rx, rule) in enumerate(rules, 1):
        for number, line in enumerate(content.split("\n"), 1):
            for m in rx.finditer(line):
                evidence = m.group("match")
                evidence = evidence[:300] + "..." if len(evidence) > 300 else evidence
                if (rule.name, evidence[:100]) not in seen:
                    seen.add((rule.name, evidence[:100]))
                    out.append((asset_id, rule_id, number, evidence))
    return out


def assets(spark, contents):
    rows = [(i, f"u{i}", "js", c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "asset_id bigint, url string, file_type string, content string")


def fill(line, k):
    digest = f"{k:032x}"[::-1]
    line = line.replace("{k}", str(k)).replace("{w}", "word")
    line = re.sub(r"\{h(\d+)\}", lambda m: digest[: int(m.group(1))], line)
    return re.sub(r"\{H(\d+)\}", lambda m: digest[: int(m.group(1))].upper(), line)


NBSP, KELVIN, LONG_S = " ", "K", "ſ"
EDGE_TEXTS = [
    "", "no newline", "\n\n", "a\r\npassword = 'abcd'\r\n", "PASSWORD='abcd'\npassword='abcd'",
    f"x{NBSP}AK" + "IA" + "A" * 16, f"x AK" + "IA" + "B" * 16 + NBSP, f"acce{LONG_S}s-to{KELVIN}en = 'abcdefghij'", f"{LONG_S}ecret: \"12345678\"",
    "token = '" + "x" * 299 + "'", "token = '" + "x" * 300 + "'", "token = '" + "x" * 301 + "'",
    "token='" + "y" * 120 + "1'\ntoken='" + "y" * 120 + "2'", "mail a@b.com,a@b.com c@d.org", "a@b.com.c@d.org x@y.net-z@w.io q@@r.com", "a.b@c.d@e.com",
    "'AK" + "IA" + "C" * 16 + "' 'AK" + "IA" + "D" * 16 + "'", "AK" + "IA" + "E" * 16 + ",AK" + "IA" + "F" * 16,
    "١٠.0.0.1 10.1.2.٣", "éeval(x) .eval(y) eval (z)", "ver=١.2", "line token = 'abcdefgh'\u0085",
    "this.$('a').html('<b>') .$(x).html(y) .$(q).html('<i>').html(z)", "location.href = 'a'; location.assign=  b",
]


def test_same_as_python(spark):
    contents = EDGE_TEXTS + [fill(line, k) for k, line in enumerate(SIGNATURE_LINES)]
    contents += ["\n".join(fill(line, 7) for line in SIGNATURE_LINES), " ".join(fill(line, 9) for line in SIGNATURE_LINES)]
    want = sorted(row for i, c in enumerate(contents) for row in brute_force(i, c))
    got = sorted(tuple(r) for r in scan_signatures(assets(spark, contents), limits=AS_SHOWN).select(*COLUMNS).collect())
    assert got == want
    assert {r[1] for r in want} == set(range(1, len(RULES) + 1))


def test_every_rule_has_a_near_miss():
    hit = {rule_id for line in SIGNATURE_LINES for _, rule_id, _, _ in brute_force(0, fill(line, 3))}
    missed = [line for line in SIGNATURE_LINES if not brute_force(0, fill(line, 3))]
    assert hit == set(range(1, 61)) and len(missed) >= 20


@pytest.mark.parametrize("prefilter", [True, False])
def test_prefilter_changes_nothing(spark, prefilter):
    contents = EDGE_TEXTS + ["\n".join(fill(line, k) for line in SIGNATURE_LINES) for k in range(3)]
    got = scan_signatures(assets(spark, contents), prefilter=prefilter, limits=AS_SHOWN).select(*COLUMNS).collect()
    want = [row for i, c in enumerate(contents) for row in brute_force(i, c)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_own_rules(spark):
    rule = Rule("Ticket", "own", "LOW", "Own", r"(?P<match>TICKET-\d+)", "i", "r")
    rows = scan_signatures(assets(spark, ["see ticket-12, TICKET-9"]), [rule]).collect()
    assert [(r.description, r.evidence, r.severity_rank) for r in rows] == [("Ticket detected", "ticket-12", 4), ("Ticket detected", "TICKET-9", 4)]


def test_anchors_cover_the_catalogue():
    assert set(ANCHORS) == {r.name for r in RULES} and len(RULES) == 60


def test_scan_has_no_shuffle(spark):
    plan = scan_signatures(assets(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_long_runs_are_read_once(spark):
    """Two million letters in one line, in a file that also holds an address."""
    blob = "ab" * 1_000_000
    rows = scan_signatures(assets(spark, [f"x = {blob};\nme@example.com"])).collect()
    assert [(r.evidence, r.line_number) for r in rows] == [("me@example.com", 2)]


def test_patterns_are_compiled_outside_of_the_rows(spark, monkeypatch):
    """Rules are no data of the plan, and texts searched together stay apart: equal evidence, line numbers, missing texts."""
    monkeypatch.setattr(matching, "_TOGETHER", 40)
    texts = ["x\npassword = 'abcd'", None, "", "password = 'abcd'\npassword = 'abcd'\n", "İ\nPAS\u017fWORD = 'wxyz'", "\n\na@b.com,a@b.com c@d.org"] * 3
    found = scan_signatures(assets(spark, texts).coalesce(1), limits=AS_SHOWN).select(*COLUMNS)
    want = [row for i, text in enumerate(texts) if text is not None for row in brute_force(i, text)]
    assert len(want) == 15 and sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_extract_all" not in plan


def test_lines_without_anchors_are_not_matched(spark):
    """Only the second line holds the anchor; the first would be a match of the pattern."""
    patterns = [LinePattern(r"(\w+)", (1,), (("key",),))]
    df = spark.createDataFrame([("plain\nkey",)], "t string")
    found = lambda searched: let(
        F.struct(F.split("t", "\n").alias("lines"), searched.alias("searched")),
        lambda p: pattern_matches(active_patterns(patterns, F.lit("key")), p.getField("lines"), 1, p.getField("searched")),
    )
    row = df.select(found(F.split("t", "\n")).alias("tried"), found(F.lit(None).cast("array<string>")).alias("every")).first()
    assert [(m.line, m.g1) for m in row.tried] == [(2, "key")]
    assert [(m.line, m.g1) for m in row.every] == [(1, "plain"), (2, "key")]
