"""Operators on small fixtures with results worked out by hand."""

import json

from pyspark.sql import functions as F

from webtally.limits import Limits
from webtally.operators import briefing as L
from webtally.operators import discovery as D
from webtally.operators import diff as X
from webtally.operators import findings as A
from webtally.operators.closure import link_closure
from webtally.operators.dataflow import sinks_sources
from webtally.operators.dependencies import dependencies
from webtally.operators.diff import diff_counts, diff_findings
from webtally.operators.endpoints import endpoints
from webtally.operators.hosts import classify_host
from webtally.operators.responses import parse_responses, response_findings, response_flows
from webtally.operators.suppression import fingerprint, suppress, suppressed, upsert_false_positives
from webtally.plans.audit import audit
from webtally.schema import FALSE_POSITIVES, FINDINGS, RESPONSES
from webtally.sources import store
from webtally.sources.assets import admit_assets, load_assets, load_requests

ASSET = "asset_id bigint, url string, file_type string, content string"


def assets(spark, *rows):
    return spark.createDataFrame([(i, f"https://h/{i}", t, c) for i, (t, c) in enumerate(rows)], ASSET)


def finding(scan_id=1, severity="HIGH", description="d", evidence="e", url="u", line=1, detector="signature"):
    return (scan_id, severity, "c", description, evidence, "i", "r", url, "js", line, detector)


def findings(spark, *rows):
    return spark.createDataFrame(list(rows), FINDINGS)


def test_first_endpoint_of_a_file_wins(spark):
    text = "axios.post('/a')\nfetch('/a')\nfetch('/b', {method: 'put'}); url = '/bbbbbbb'\nfetch('/x.css')\n" + " " * 50 + "$.get('/late') // post"
    got = [(r.line, r.method, r.url, r.context) for r in endpoints(assets(spark, ("txt", text))).orderBy("line", "url").collect()]
    assert got == [(1, "POST", "/a", "axios"), (3, "PUT", "/b", "fetch"), (3, "UNKNOWN", "/bbbbbbb", "assignment"), (5, "GET", "/late", "jquery")]


def test_dependencies_of_a_manifest(spark):
    manifest = json.dumps({"dependencies": {"jquery": "^1.2.3", "Lodash": ">=4.17.21 <5"}, "devDependencies": {"JQUERY": "1.2.3", "x": "latest"}})
    broken = manifest + " trailing"
    rows = dependencies(assets(spark, ("json", manifest), ("json", broken), ("txt", manifest))).orderBy("asset_id", "ord").collect()
    assert [(r.asset_id, r.name, r.version, r.cve) for r in rows] == [(0, "jquery", "1.2.3", "CVE-2020-11022"), (0, "Lodash", "4.17.21", ""), (0, "x", "latest", "")]


def test_banner_may_be_looked_for_near_the_top_only(spark):
    late = " " * 5000 + "/*! jQuery v1.0.0 */"
    assert dependencies(assets(spark, ("js", late))).count() == 1
    assert dependencies(assets(spark, ("js", late)), limits=Limits(banner=5000)).count() == 0
    assert dependencies(assets(spark, ("js", "/*! jQuery v1.0.0 */"))).count() == 1


def test_one_row_per_sink_and_line(spark):
    text = "a.innerHTML = x; b.innerHTML = y\n// c.innerHTML = z\n\nlet q = location.hash"
    got = [(r.line, r.name, r.data_flow_hint) for r in sinks_sources(assets(spark, ("js", text), ("css", text))).orderBy("line").collect()]
    assert got == [(1, "innerHTML", "a"), (4, "URL parameters", "")]
    long_hint = "eval(" + "v" * 100 + ")"
    assert sinks_sources(assets(spark, ("js", long_hint))).first().data_flow_hint == "v" * 60


def test_merge_dedupe_rank(spark):
    rows = findings(
        spark, finding(detector="llm", severity="LOW"), finding(), finding(evidence="e2", severity=None), finding(evidence="e" * 120 + "1"), finding(evidence="e" * 120 + "2"),
    )
    assert A.dedupe_findings(rows).count() == 4
    kept = A.dedupe_findings(rows, key_chars=100)
    assert kept.count() == 3 and kept.where("evidence = 'e'").first().detector == "signature"
    assert {r.severity: r.n for r in A.severity_counts(kept).collect()} == {"HIGH": 2, "UNKNOWN": 1}
    assert [r.severity for r in A.ranked(kept).collect()][-1] is None


def test_hot_finding_is_limited_before_the_shuffle(spark):
    copies = spark.range(20000, numPartitions=8).select(
        F.concat(F.lit("u"), F.col("id") % 1).alias("source_url"), F.concat(F.lit("e"), F.col("id") % 1).alias("evidence"),
        F.lit("d").alias("description"), F.lit("signature").alias("detector"), F.lit("HIGH").alias("severity"), F.col("id").cast("int").alias("line_number"),
    )
    kept = A.dedupe_findings(copies)
    assert [r.line_number for r in kept.collect()] == [0]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_suppression(spark):
    print_of = lambda e: spark.range(1).select(fingerprint(F.lit(e))).first()[0]
    found = findings(spark, finding(evidence="a"), finding(evidence="b"), finding(evidence="c")).withColumn("target", F.lit("t1"))
    listed = spark.createDataFrame([(1, "t1", "other", print_of("a"), "", 1, None), (2, "*", "d", print_of("b"), "", 1, None), (3, "t2", "d", print_of("c"), "", 1, None)], FALSE_POSITIVES)
    assert [r.evidence for r in suppress(found, listed).collect()] == ["c"]
    assert suppressed(found, listed).count() + suppress(found, listed).count() == found.count()
    replaced = upsert_false_positives(listed, spark.createDataFrame([(9, "t1", "new", print_of("a"), "why", 2, None)], FALSE_POSITIVES))
    assert sorted(r.id for r in replaced.collect()) == [2, 3, 9]


def test_diff(spark):
    old = findings(spark, finding(evidence="gone"), finding(evidence="same"), finding(evidence="moved", severity="LOW"), finding(evidence="x" * 80 + "1", severity="CRITICAL"), finding(evidence="x" * 80 + "2", severity="INFO"))
    new = findings(spark, finding(evidence="same"), finding(evidence="moved", severity="HIGH"), finding(evidence="fresh", severity="ODD"), finding(evidence="x" * 80 + "3", severity="INFO"))
    assert diff_findings(old, new).count() == 7
    diff = diff_findings(old, new, key_chars=80)
    assert {(r.status, r.evidence[:5]) for r in diff.collect()} == {("resolved", "gone"), ("unchanged", "same"), ("changed", "moved"), ("new", "fresh"), ("unchanged", "xxxxx")}
    assert diff.count() == 5
    delta = diff_counts(A.severity_counts(old), A.severity_counts(new)).collect()
    assert {(r.severity, r.old, r.new, r.delta) for r in delta} == {("CRITICAL", 1, 0, -1), ("LOW", 1, 0, -1)}


def test_link_closure(spark):
    page = lambda i, *links: (i, f"http://h/{i}", "<body>" + "".join(f'<a href="{x}">x</a>' for x in links) + "</body>")
    rows = [page(0, "/1", "/2", "/0", "http://o/9"), page(1, "/3#a", "/0"), page(2, "/3", "/x.png"), page(3, "/4"), page(4, "/5"), page(5), (9, "http://o/9", "<body></body>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    start = pages.where("page_id = 0").select("url")
    got = sorted((r.depth, r.url) for r in link_closure(pages, start, 20).collect())
    assert got == [(0, "http://h/0"), (1, "http://h/1"), (1, "http://h/2"), (2, "http://h/3"), (3, "http://h/4"), (4, "http://h/5")]
    assert got == sorted((r.depth, r.url) for r in link_closure(pages, start).collect())  # no cap unless asked for
    capped = sorted((r.depth, r.url) for r in link_closure(pages, start, 3).collect())
    assert capped == got[:3]


def test_html_references(spark):
    html = """<!-- <img src="/no.png"> --><script>'<img src="/no2.png">'</script>
<img src=a.png alt='x'><IMG SRC='b.png'><img data-src="no.png" src="c>d.png"><link rel=x href="?a=1&amp;b=2"><script src="s.js"/></script>"""
    pages = spark.createDataFrame([(1, "https://h/p/q", html)], "page_id bigint, url string, html string")
    got = sorted((r.kind, r.target) for r in D.html_refs(pages).collect())
    assert got == [("img", "https://h/p/a.png"), ("img", "https://h/p/b.png"), ("img", "https://h/p/c>d.png"), ("link", "https://h/p/q?a=1&b=2"), ("script", "https://h/p/s.js")]


def test_sensitive_paths(spark):
    found = spark.createDataFrame([("https://h/info.php",), ("https://h/environment",), ("https://h/x",)], "target string")
    loose = sorted((r.target[10:], r.path) for r in D.sensitive_path_match(found).collect())
    assert loose == [("environment", "/env"), ("info.php", "/info"), ("info.php", "/info.php")]
    assert [r.path for r in D.sensitive_path_match(found, exact=True).collect()] == ["/info.php"]


def test_a_target_is_resolved_once_for_all_paths(spark):
    """The target is an expression; bound, it stands in the filter once and not in the search of each path."""
    found = spark.createDataFrame([("a/", "x.json"), ("a/", "x.png"), ("a", "/.git/config"), (None, "x")], "u string, v string")
    refs = D.interesting_refs(found.select(F.concat("u", "v").alias("target")))
    assert sorted(r.target for r in refs.collect()) == ["a/.git/config", "a/x.json"]
    condition = next(x for x in refs._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x)
    assert condition.count("concat(") == 1


def test_hosts(spark):
    edges = {"9.255.255.255": True, "10.0.0.0": False, "10.255.255.255": False, "11.0.0.0": True, "172.15.255.255": True, "172.31.255.255": False, "192.169.0.0": True,
             "198.17.255.255": True, "198.18.0.0": False, "198.20.0.0": True, "100.63.255.255": True, "100.64.0.0": False, "a.localhost": False, "notlocalhost": True, "1.2.3": True}
    df = classify_host(spark.createDataFrame([(f"http://{h}/", ok) for h, ok in edges.items()], "url string, ok boolean"))
    assert [r.url for r in df.where("allowed <> ok").collect()] == []
    assert classify_host(spark.createDataFrame([("http://[::1/",)], "url string")).first().reason.startswith("URL validation error")


def test_responses(spark):
    body = {"findings": [{"severity": "HIGH", "description": "x"}], "data_flow_confirmed": [{"source": "a", "sink": "b", "exploitable": True}], "summary": "s"}
    raws = [json.dumps(body), "prose " + json.dumps(body) + " end", json.dumps(body) + " " + json.dumps(body), "{broken", "none", '{"findings": []}']
    raw = spark.createDataFrame([(i, f"u{i}", "js", r) for i, r in enumerate(raws)], RESPONSES)
    parsed = parse_responses(raw)
    assert [r.is_raw for r in parsed.orderBy("asset_id").collect()] == [False, False, True, True, True, False]
    assert sorted(r.source_url for r in response_findings(parsed).collect()) == ["u0", "u1"]
    assert response_flows(parsed).count() == 2 and parsed.where("asset_id = 4").first().summary == "none"


def test_briefing_text(spark):
    text = "\n".join(["const apiKey = 'k';", "app.get('/r', h)", "function f(a) {}", "class C {", "el.addEventListener('click', f)", "el.innerHTML = location.hash", "fetch('/api/x')", "/* jQuery 1.0.0 */", "password = 'abcd'"])
    got = L.briefings(L.with_extracts(assets(spark, ("js", text), ("txt", "nothing")))).orderBy("asset_id").collect()
    assert got[0].briefing == (
        "REGEX FINDINGS:\n  [HIGH] Hardcoded Password detected: abcd\n  [MEDIUM] innerHTML Assignment detected: .innerHTML =\n\n"
        "ENDPOINTS EXTRACTED:\n  GET      /api/x  (via fetch, line 7)\n\n"
        "DEPENDENCIES:\n  jQuery 1.0.0 [inline_banner] ⚠ VULNERABLE (CVE-2020-11022)\n\n"
        "DANGEROUS SINKS:\n  SINK [xss] innerHTML (line 6): el.innerHTML = location.hash\n\n"
        "USER-CONTROLLED SOURCES:\n  SOURCE [url] URL parameters (line 6): el.innerHTML = location.hash\n\n"
        "CODE STRUCTURE:\n  Route definitions: 1\n    GET /r (line 2)\n  Interesting variables: 1\n    apiKey = 'k' (line 1)\n"
        "  Functions: 1 (f)\n  Classes: C\n  Event listeners: click"
    )
    assert got[1].briefing == "(No deterministic findings)"


def test_audit_works_on_normalised_text(spark):
    hidden = "var u = \"htt\" + \"ps://api.dev.corp.com/\"; \\x65val(x)"
    result = audit(assets(spark, ("js", hidden)))
    assert {r.description for r in result["findings"].collect()} == {"eval() Usage detected", "Internal/Staging Hostname detected"}
    assert result["files"].first().sig_findings_count == 2
    assert set(result) == {"findings", "code_facts", "endpoints", "dependencies", "sinks_sources", "briefings", "files"}


def test_sources(spark, tmp_path):
    rows = [(1, "http://h/a.js", "x", 200, "text/js"), (2, "http://h/b", "x", 404, "text/js"), (3, "http://h/c", "x", 200, "image/png"), (4, "http://h/d", "éé", 200, None), (5, "http://h/e", "ééé", 200, "text/x")]
    fetched = spark.createDataFrame(rows, "asset_id bigint, url string, content string, status int, content_type string")
    admitted = admit_assets(fetched, max_bytes=5)
    assert sorted((r.asset_id, r.file_type, r.size) for r in admitted.collect()) == [(1, "js", 1), (4, "unknown", 2)]
    admitted.write.parquet(str(tmp_path / "assets"))
    assert load_assets(spark, str(tmp_path / "assets")).count() == 2
    line = {"page_url": "p", "url": "u", "method": "GET", "resource_type": "xhr", "headers": {"a": "b"}}
    (tmp_path / "log.json").write_text(json.dumps(line) + "\n")
    assert load_requests(spark, str(tmp_path / "log.json")).first().headers == {"a": "b"}


def test_store(spark, tmp_path):
    found = findings(spark, finding(1, evidence="s"), finding(1, evidence="t"), finding(2, evidence="u"))
    scans = spark.createDataFrame([(1, "t1"), (2, "t2")], "id bigint, target string")
    path, key = str(tmp_path / "store"), F.lit("0123456789abcdef")
    store.write_scan(scans, found, path, key)
    store.write_scan(scans.where("id = 1"), found.where("scan_id = 1 and evidence = 's'"), path, key)
    kept = store.read_findings(spark, path)
    assert sorted(r.scan_id for r in kept.collect()) == [1, 2]
    store.write_scan(scans.where("id = 2"), found.where("scan_id = 0"), path, key)  # it has become clean
    assert [r.scan_id for r in store.read_findings(spark, path).collect()] == [1]
    store.delete_scans(scans.where("id = 1"), path)
    assert [r.scan_id for r in store.read_scans(spark, path).collect()] == [2] and store.read_findings(spark, path).isEmpty()
    kept = spark.read.parquet(f"{path}/generation=0/findings")
    assert all(r.evidence.startswith("aesgcm:") for r in kept.collect())
    header = store.report_counts(found).join(scans.withColumnRenamed("id", "scan_id"), "scan_id")
    lines = store.report_json(header, findings=found)
    report = json.loads(lines.where("scan_id = 1 and part = 'report'").first().json)
    assert report == {"target": "t1", "total_findings": 2, "severity_counts": {"HIGH": 2}, "detector_counts": {"signature": 2}}
    store.write_report(lines, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 5


def test_compaction_keeps_what_counts(spark, tmp_path):
    """Versions come from the table; compaction drops replaced and deleted rows, and a broken one changes nothing."""
    path = str(tmp_path / "store")
    scans = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, target string")
    found = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, "w")], "scan_id long, evidence string")
    store.write_scan(scans, found, path)
    store.write_scan(scans.where("id = 1"), found.where("evidence = 'y'"), path)
    store.delete_scans(scans.where("id = 3"), path)
    assert sorted(r.version for r in spark.read.parquet(f"{path}/generation=0/scans").collect()) == [1, 1, 1, 2, 3]
    want = [(1, "y"), (2, "z")]
    rows = lambda *a: sorted(map(tuple, store.read_findings(spark, path, *a).collect()))
    assert rows() == want and rows(1) == want[:1] and rows(3) == []
    found.where("false").write.parquet(f"{path}/generation=1/findings")  # a compaction that broke off
    assert rows() == want
    store.compact_scans(spark, path)
    assert not (tmp_path / "store" / "generation=0").exists()
    assert rows() == want and spark.read.parquet(f"{path}/generation=1/findings").count() == 2
    store.write_scan(scans.where("id = 2"), found.where("false"), path)
    assert rows() == want[:1] and sorted(r.scan_id for r in store.read_scans(spark, path).collect()) == [1, 2]
    store.delete_scans(scans, path)
    store.compact_scans(spark, path)
    assert rows() == [] and store.read_scans(spark, path).isEmpty()


def test_documents_are_scanned_once_for_both_writes(spark, tmp_path, monkeypatch):
    from webtally.queries import event_queries as E
    from webtally.queries.registry import QUERIES

    seen = spark.sparkContext.accumulator(0)
    spark.range(20).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    counted = F.udf(lambda k: (seen.add(1), k)[1], "bigint")
    found = spark.range(20).select(F.col("id").alias("asset_id"), counted("id").alias("line_number"), F.lit("e").alias("evidence"))
    monkeypatch.setattr(E, "document_findings", lambda *_: found)
    kept = QUERIES["s7_compacted_scans"](spark, str(tmp_path))
    assert sorted(r.asset_id for r in kept.collect()) == [k for k in range(20) if k % 7 not in (2, 3)]
    assert seen.value == 20


def test_reading_one_scan_is_pruned(spark, tmp_path, capsys):
    path = str(tmp_path / "store")
    store.write_scan(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, "x"), (2, "y")], "scan_id long, evidence string"), path)
    store.read_findings(spark, path, 2).explain()
    assert "EqualTo(scan_id,2)" in capsys.readouterr().out


def test_closure_keeps_edges_and_reached_where_they_lie(spark, monkeypatch):
    """The tables of the closure are read in their buckets: only the frontier and its links are exchanged."""
    from webtally.operators import closure

    edges = closure._append(spark.range(200).select(F.col("id").alias("url"), (F.col("id") + 1).alias("link")), "closure_test_edges")
    reached = closure._append(spark.range(50).select(F.col("id").alias("url")), "closure_test_reached")
    reached = closure._append(spark.range(60, 80).select(F.col("id").alias("url")), "closure_test_reached")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = spark.range(40, 120).select(F.col("id").alias("url")).join(edges, "url").groupBy(F.col("link").alias("url")).count()
        left = found.join(reached, "url", "left_anti")
        assert sorted(r["url"] for r in left.collect()) == [*range(50, 60), *range(80, 121)]
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 or plan.count("Bucketed: true") >= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("closure_test_edges", "closure_test_reached"):
            spark.sql(f"DROP TABLE {name}")


def test_link_closure_of_long_chains_takes_few_rounds(spark, monkeypatch):
    from webtally.operators import closure

    n, steps = 60, (1, 4)
    links = {i: [i + s for s in steps if i + s < n] + [i // 2] for i in range(n)}
    url = lambda i: f"http://s{i // 25}/{i}"
    anchors = lambda i: "".join(f"<script>navigate('{url(x)}')</script><a href=\"{url(x)}\">x</a>" for x in links[i])
    pages = spark.createDataFrame([(i, url(i), f"<body>{anchors(i)}</body>") for i in range(n)], "page_id bigint, url string, html string")
    rounds = []
    monkeypatch.setattr(closure, "reliable_checkpoint", lambda df, real=closure.reliable_checkpoint: rounds.append(1) or real(df))
    # links to other sites are not followed: each site has its own start
    start = pages.where("page_id IN (0, 25, 50)").select("url")
    depth, frontier = {0: 0, 25: 0, 50: 0}, [0, 25, 50]
    while frontier:
        found = {x: depth[i] + 1 for i in frontier for x in links[i] if x // 25 == i // 25 and x not in depth}
        depth.update(found)
        frontier = list(found)
    assert {r.url: r.depth for r in link_closure(pages, start).collect()} == {url(i): d for i, d in depth.items()}
    chain = spark.createDataFrame([(i, url(0) + f"/{i}", f'<body><a href="{url(0)}/{i + 1}">x</a></body>') for i in range(n)], "page_id bigint, url string, html string")
    rounds.clear()
    assert sorted(r.depth for r in link_closure(chain, chain.where("page_id = 0").select("url")).collect()) == list(range(n))
    assert len(rounds) < 10


def test_link_closure_over_many_pieces(spark):
    from webtally.operators.closure import _whole

    n = 40
    url = lambda i: f"http://s{i % 3}/{i}"
    edges = {(i, j) for i in range(n) for j in (i + 7, i * 3 % n, i // 2) if j < n}
    depth, frontier = {5: 0, 8: 0}, [5, 8]
    while frontier:
        found = {b: depth[a] + 1 for a in frontier for x, b in edges if x == a and b not in depth}
        depth.update(found)
        frontier = list(found)
    stored = spark.createDataFrame([(f"s{i % 3}", url(i)) for i in range(n)], "site string, url string")
    links = spark.createDataFrame([(url(a), url(b)) for a, b in edges], "url string, link string")
    for piece in (5, 1000):
        got = _whole(stored, links, stored.where(stored.url.isin(url(5), url(8))), piece).collect()
        assert {(r.site, r.url, r.depth) for r in got} == {(f"s{i % 3}", url(i), d) for i, d in depth.items()}
        assert len(got) == len(depth)
    assert _whole(stored, links, stored.limit(0), 5).isEmpty()


def test_lines_without_banners_are_left_out_of_the_search(spark):
    import random

    from webtally.functions.patterns import active_patterns, pattern_matches
    from webtally.functions.text import let
    from webtally.operators.dependencies import _BANNERS, banner_lines

    rnd = random.Random(5)
    pieces = ["* ", "/", "!", "lib", "b.c-d", " ", "\n", "\n\n", "v", "1.2", "1.2.3", "٣.٤", ".", "\t", "\r", " ", "x", "#", "7", "é"]
    texts = ["".join(rnd.choices(pieces, k=rnd.randint(0, 25))) for _ in range(4000)] + ["* lib \n\n \nv1.2.3\n", "* lib\nnothing\n1.2.3 ", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = lambda c: let(c, lambda text: pattern_matches(active_patterns(_BANNERS, text), F.array(text), 2))
    rows = df.select("t", found(F.col("t")).alias("whole"), found(banner_lines(F.col("t"))).alias("part")).collect()
    assert sum(bool(r.whole) for r in rows) > 100
    assert [r.t for r in rows if r.whole != r.part] == []
    long = spark.createDataFrame([("/* filler of a bundle */\n" * 300 + " * jQuery v3.6.0\n",)], "t string")
    assert len(long.select(banner_lines(F.col("t"))).first()[0]) < 1000


def test_derived_files_lie_in_a_task_per_core_at_least(spark):
    from webtally.queries import code_queries, corpus, signature_queries

    cores, sf = spark.sparkContext.defaultParallelism, "/root/testdata/sf0.001"
    for files in (corpus.leaky_files, corpus.manifest_files, code_queries.bundles, signature_queries.long_files):
        assert files(spark, sf).rdd.getNumPartitions() >= cores


def test_large_bases_lie_in_tasks_of_bounded_rows(spark, tmp_path):
    """Rows decide, not stored bytes: a base that compresses well has as many tasks."""
    from webtally.queries.corpus import SPREAD_ROWS, spread_rows

    rows = 12 * SPREAD_ROWS
    spark.range(rows).select("id", F.lit("same word").alias("w")).write.parquet(f"{tmp_path}/base")
    assert spread_rows(spark.read.parquet(f"{tmp_path}/base")).rdd.getNumPartitions() >= 12


FINDING_ROWS = [
    ("LOW", "d", None, "u", 1, "x"), ("LOW", "d", "", "u", 2, "x"), ("HIGH", "d", "e" * 200 + "1", "u", 3, "x"), ("HIGH", "d", "e" * 200 + "2", "u", None, "x"),
    ("LOW", None, "e", None, 4, "signature"), ("LOW", "", "e", "", 5, "y"), ("INFO", "d", "f", "u", 6, None), ("HIGH", "d", "f", "u", 7, None), ("HIGH", "d", "f", "u", 8, "z"),
]
FINDING_DDL = "severity string, description string, evidence string, source_url string, line_number int, detector string"


def test_keyed_findings_are_sorted_by_a_hash_first(spark):
    rows = [finding(), finding(severity="LOW"), finding(evidence=None), finding(evidence=""), finding(description=None)]
    old = findings(spark, *rows)
    keyed = X.keyed_findings(old)
    assert keyed.columns == [*X.KEY, "f"] and sorted(r.f.severity for r in keyed.collect()) == ["HIGH", "HIGH", "LOW"]
    diff = X.diff_findings(old, findings(spark, finding()))
    assert sorted(r.status for r in diff.collect()) == ["changed", "resolved", "resolved"]
    plan = diff._jdf.queryExecution().sparkPlan().toString()
    join = next(x for x in plan.split("\n") if "SortMergeJoin" in x)
    assert join.split("[")[1].startswith("k_hash")


def test_keyed_findings_sort_their_texts_once(spark):
    found = spark.createDataFrame(FINDING_ROWS, FINDING_DDL)
    whole = X.keyed_findings(found)
    assert {(tuple(r)[:3], tuple(r.f)) for r in whole.collect()} == {
        (("d", "u", ""), ("LOW", "d", "", "u", 2, "x")), (("", "", "e"), ("LOW", "", "e", "", 5, "y")), (("d", "u", "f"), ("INFO", "d", "f", "u", 6, None)),
        (("d", "u", "e" * 200 + "1"), ("HIGH", "d", "e" * 200 + "1", "u", 3, "x")), (("d", "u", "e" * 200 + "2"), ("HIGH", "d", "e" * 200 + "2", "u", None, "x")),
    }
    short = {r.k_evidence: r.f.evidence for r in X.keyed_findings(found, 100).collect()}
    assert short == {"": "", "e": "e", "f": "f", "e" * 100: "e" * 200 + "1"}
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(evidence" in plan and "max_by" not in plan


def test_dedupe_sorts_whole_evidence_once(spark):
    found = spark.createDataFrame(FINDING_ROWS, FINDING_DDL)
    whole = A.dedupe_findings(found)
    assert whole.columns == found.columns
    assert {tuple(r) for r in whole.collect()} == {FINDING_ROWS[i] for i in (0, 2, 3, 4, 6)}
    assert {tuple(r) for r in A.dedupe_findings(found, key_chars=100).collect()} == {FINDING_ROWS[i] for i in (0, 3, 4, 6)}
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit [source_url#" in plan
