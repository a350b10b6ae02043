"""Sources (S), references and links (D), hosts (D20) over pages, documents and derived sites."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..catalog.paths import SENSITIVE_PATHS, STATIC_EXTENSIONS, UNFOLLOWED_SUBSTRINGS, UNFOLLOWED_SUFFIXES
from ..functions import urls
from ..functions.text import strings
from ..operators import discovery as D
from ..operators.diff import diff_sets
from ..operators.closure import closure_static_refs, link_closure
from ..operators.endpoints import endpoint_names, endpoint_set, endpoints
from ..operators.hosts import classify_host
from ..operators.responses import parse_responses, response_endpoints
from ..session import shared_folder
from ..sources.assets import admit_assets, documents_as_assets, load_requests, pages_as_assets, spread_small
from .code_queries import ENDPOINT_SQL, files
from .corpus import quote, spread_rows, table
from .registry import query
from .report_queries import responses_table


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small(table(spark, sf_dir, "pages"))


# -- sources --------------------------------------------------------------------------

@query(
    "s1_load_assets",
    """SELECT page_id AS asset_id, url, 'html' AS file_type, md5(html) AS content_md5, length(html) AS size FROM pages
 UNION ALL SELECT doc_id, 'doc://' || doc_id, 'txt', md5(text), length(text) FROM documents""",
)
def _(spark, sf_dir):
    both = pages_as_assets(pages(spark, sf_dir)).unionByName(documents_as_assets(table(spark, sf_dir, "documents")))
    return both.select("asset_id", "url", "file_type", F.md5("content").alias("content_md5"), "size")


FETCH_TYPES = ["text/html", "image/png", "application/javascript", "font/woff2", "application/octet-stream", "text/css", "video/mp4"]
FETCH_PATHS = ["/a/app.JS", "/.env", "/index", "/x/y.min.css?v=1", "/dir.d/readme", "/f.tar.gz;v=2", "/archive.v1/", "/.well-known/a.txt#t"]


@query(
    "s2_s3_admit_assets",
    f"""SELECT asset_id, url, coalesce(nullif(CASE f WHEN 0 THEN 'js' WHEN 3 THEN 'css' WHEN 5 THEN 'gz' WHEN 6 THEN 'v1' WHEN 7 THEN 'txt' ELSE '' END, ''), 'unknown') AS file_type,
 length(text) AS size FROM (SELECT doc_id AS asset_id, 'https://h' || (doc_id % 9) || '.example.com' || [{', '.join(quote(p) for p in FETCH_PATHS)}][doc_id % 8 + 1] AS url,
 doc_id % 8 AS f, text, CASE doc_id % 10 WHEN 9 THEN 404 ELSE 200 END AS status, [{', '.join(quote(t) for t in FETCH_TYPES)}][doc_id % 7 + 1] AS content_type FROM documents)
 WHERE status = 200 AND content_type IN ('text/html', 'application/javascript', 'text/css') AND strlen(text) <= 3000""",
)
def _(spark, sf_dir):
    k = F.col("doc_id")
    pick = lambda values, n: F.element_at(strings(values), (k % n + 1).cast("int"))
    fetched = spread_small(table(spark, sf_dir, "documents")).select(
        k.alias("asset_id"), F.concat(F.lit("https://h"), k % 9, F.lit(".example.com"), pick(FETCH_PATHS, 8)).alias("url"),
        F.col("text").alias("content"), F.when(k % 10 == 9, 404).otherwise(200).alias("status"),
        pick(FETCH_TYPES, 7).alias("content_type"),
    )
    return admit_assets(fetched, max_bytes=3000).select("asset_id", "url", "file_type", "size")


# -- real pages -----------------------------------------------------------------------

PAGE_PARTS = """p AS (SELECT *, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, regexp_extract(url, '^https?://([^/?#]*)', 1) AS site FROM pages)"""
PLAIN_URL = "split_part(url, '#', 1)"
NO_FOLLOW = " OR ".join(
    [f"ends_with(lower(split_part(link, '?', 1)), {quote(s)})" for s in UNFOLLOWED_SUFFIXES]
    + [f"contains(lower(link), {quote(s)})" for s in UNFOLLOWED_SUBSTRINGS]
)
LINKS_SQL = f"""WITH {PAGE_PARTS}, hrefs AS (SELECT page_id, url, origin, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM p),
links AS (SELECT DISTINCT page_id, url, origin || split_part(href, '#', 1) AS link FROM hrefs)
"""


@query("d12_page_links", LINKS_SQL + f"SELECT page_id, url, link FROM links WHERE NOT ({NO_FOLLOW})")
def _(spark, sf_dir):
    return D.page_links(pages(spark, sf_dir))


@query("s3_file_type", "SELECT page_id, url, coalesce(nullif(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+/(?:.*[^/])?\\.([^./]+)$', 1)), ''), 'unknown') AS file_type FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.file_type(F.col("url")).alias("file_type"))


@query("d8_resolve_root_relative", LINKS_SQL + "SELECT page_id, href, origin || href AS target FROM hrefs")
def _(spark, sf_dir):
    hrefs = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.explode_outer(D.attribute_values(D.visible_markup(F.col("html")), "a", "href")).alias("href")
    ).where(F.col("href").isNotNull())
    return hrefs.select("page_id", "href", urls.resolve_url(F.col("url"), F.col("href")).alias("target"))


@query("d9_normalize_url", f"SELECT page_id, url, {PLAIN_URL} AS normalized FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.normalize_url(F.col("url"), F.col("url")).alias("normalized"))


@query("d10_same_origin", f"WITH {PAGE_PARTS} SELECT page_id, site, ends_with(site, '.example.com') AND NOT contains(site[:-13], '.') AND site[:-13] = 'www' AS is_www FROM p")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.netloc(F.col("url")).alias("site"), urls.same_origin(F.col("url"), F.lit("www.example.com")).alias("is_www")
    )


@query("d11_should_follow", LINKS_SQL + f"SELECT page_id, link, NOT ({NO_FOLLOW}) AS follow FROM (SELECT page_id, url AS link FROM pages)")
def _(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", u.alias("link"), urls.should_follow(u, urls.netloc(u)).alias("follow"))


_PATHS = "(VALUES " + ", ".join(f"({quote(p)})" for p in SENSITIVE_PATHS) + ") s(path)"
TARGETS_SQL = LINKS_SQL + ", targets AS (SELECT DISTINCT page_id, origin || href AS target FROM hrefs)"


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages(spark, sf_dir).select(
        "page_id", "url", F.explode_outer(D.attribute_values(D.visible_markup(F.col("html")), "a", "href")).alias("href")
    ).where(F.col("href").isNotNull())
    return found.select("page_id", urls.resolve_url(F.col("url"), F.col("href")).alias("target")).distinct()


@query(
    "d7_interesting_refs",
    TARGETS_SQL + f" SELECT page_id, target FROM targets WHERE regexp_extract(target, '[^/]\\.([^./]+)/*$', 1) IN ({', '.join(quote(e) for e in STATIC_EXTENSIONS)}) "
    f"OR EXISTS (SELECT 1 FROM {_PATHS} WHERE contains(target, path))",
)
def _(spark, sf_dir):
    return D.interesting_refs(link_targets(spark, sf_dir))


@query("d17_sensitive_path_match", TARGETS_SQL + f" SELECT page_id, target, path FROM targets JOIN {_PATHS} ON contains(target, path)")
def _(spark, sf_dir):
    return D.sensitive_path_match(link_targets(spark, sf_dir))


# -- derived sites ----------------------------------------------------------------------
# Every part is a page of one of 50 sites. Each form below is a piece of markup with
# the references it holds and the absolute URLs they stand for, worked out by hand:
# {k} is the page, {s} its site, the page is https://w{s}.example.com/p/{k}.

HOST = "https://w{s}.example.com"
# (markup, [(operator, kind, target)])
FORMS: list[tuple[str, list[tuple[str, str, str]]]] = [
    ('<script src="/js/app-{k}.js"></script>', [("d1", "script", HOST + "/js/app-{k}.js"), ("d3", "quoted", HOST + "/js/app-{k}.js"), ("d4", "chunk", HOST + "/js/app-{k}.js")]),
    ("<SCRIPT defer SRC='lib/{k}.mjs'></SCRIPT>", [("d1", "script", HOST + "/p/lib/{k}.mjs")]),
    ('<link rel="stylesheet" href="../css/main.css?v={k}">', [("d1", "link", HOST + "/css/main.css?v={k}")]),
    ('<form method=post action="?save={k}"><input></form>', [("d1", "form", HOST + "/p/{k}?save={k}")]),
    ('<img alt="a > b" src="//cdn{s}.example.net/i/{k}.png">', [("d1", "img", "https://cdn{s}.example.net/i/{k}.png"), ("d3", "quoted", "https://cdn{s}.example.net/i/{k}.png")]),
    ('<iframe src="https://other.example.org/f?a=1&amp;b={k}"></iframe>', [("d1", "iframe", "https://other.example.org/f?a=1&b={k}"), ("d3", "quoted", "https://other.example.org/f?a=1&amp;b={k}")]),
    ("<embed src=./e/{k}.swf>", [("d1", "embed", HOST + "/p/e/{k}.swf")]),
    ('<object data="/a/./b/../{k}.pdf"></object>', [("d1", "object", HOST + "/a/{k}.pdf"), ("d3", "quoted", HOST + "/a/{k}.pdf")]),
    ('<meta http-equiv="refresh" content="5; URL=\'/next/{k}\'">', [("d2", "meta", HOST + "/next/{k}")]),
    ('<meta http-equiv="Refresh" content="5; url=/ignored/{k}">', []),
    ("<script>load('/data/{k}.json'); var m = \"chunks/{k}.chunk.js\", n = `https://api{s}.example.net/v1`;</script>",
     [("d3", "quoted", HOST + "/data/{k}.json"), ("d3", "quoted", "https://api{s}.example.net/v1"), ("d4", "chunk", HOST + "/chunks/{k}.chunk.js")]),
    ("<script>x.src = '/static/js/main.{k}.js'; y('v/{k}.bundle.js')</script>",
     [("d3", "quoted", HOST + "/static/js/main.{k}.js"), ("d4", "chunk", HOST + "/static/js/main.{k}.js"), ("d4", "chunk", HOST + "/v/{k}.bundle.js")]),
    ('<!-- <script src="/old/{k}.js"></script> -->', [("d3", "quoted", HOST + "/old/{k}.js")]),
    ("<script>document.write('<img src=\"gone-{k}\">')</script>", []),
    ('<p title="plain">nothing {k}</p>', []),
]
N_FORMS = 4  # forms per page
STRIDE = 4


def _site_text(form: Column) -> Column:
    k = F.col("page_id")
    return F.replace(F.replace(form, F.lit("{k}"), k.cast("string")), F.lit("{s}"), (k % 50).cast("string"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that link to later pages of their site and hold four forms each."""
    k = F.col("page_id")
    forms = strings([m for m, _ in FORMS])
    links = (
        '<a href="/p/@1">one</a><a href="@2#part">two</a><a href="/p/@3?page=2">three</a>'
        '<a href="mailto:x@example.com">m</a><a href="/logo.png">l</a><script>navigate("/p/@4")</script>'
    )
    body = F.concat_ws("", *[F.element_at(forms, ((k * N_FORMS + j * STRIDE) % len(FORMS) + 1).cast("int")) for j in range(N_FORMS)])
    nav = F.lit(links)
    for name, step in (("@1", 50), ("@2", 150), ("@3", 200), ("@4", 400)):
        nav = F.replace(nav, F.lit(name), (k + step).cast("string"))
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"))
    return spread_rows(base).select(
        "page_id", _site_text(F.lit(HOST + "/p/{k}")).alias("url"),
        F.concat(F.lit("<!DOCTYPE html><html><body>"), nav, _site_text(body), F.lit("</body></html>")).alias("html"),
    )


EXPECTED = [(i, op, kind, target) for i, (_, refs) in enumerate(FORMS) for op, kind, target in refs]
SITE_REFS_SQL = f"""WITH forms(form, op, kind, target) AS (VALUES {', '.join(f"({i}, {quote(op)}, {quote(kind)}, {quote(t)})" for i, op, kind, t in EXPECTED)}),
site AS (SELECT p_partkey AS page_id, replace(replace({quote(HOST + '/p/{k}')}, '{{k}}', p_partkey::VARCHAR), '{{s}}', (p_partkey % 50)::VARCHAR) AS url FROM part),
slots AS (SELECT page_id, url, unnest([{', '.join(f'(page_id * {N_FORMS} + {j * STRIDE}) % {len(FORMS)}' for j in range(N_FORMS))}]) AS form FROM site),
nav AS (SELECT page_id, url, 'https://w' || (page_id % 50) || '.example.com' AS origin FROM site),
refs AS (SELECT DISTINCT page_id, url, op, kind, replace(replace(target, '{{k}}', page_id::VARCHAR), '{{s}}', (page_id % 50)::VARCHAR) AS target FROM slots JOIN forms USING (form)
 UNION SELECT page_id, url, 'd3', 'quoted', origin || '/logo.png' FROM nav)
"""


@query("d1_html_refs", SITE_REFS_SQL + "SELECT page_id, url, kind, target FROM refs WHERE op = 'd1'")
def _(spark, sf_dir):
    return D.html_refs(site_pages(spark, sf_dir)).select("page_id", "url", "kind", "target")


@query("d2_meta_refresh_refs", SITE_REFS_SQL + "SELECT page_id, url, target FROM refs WHERE op = 'd2'")
def _(spark, sf_dir):
    return D.meta_refresh_refs(site_pages(spark, sf_dir)).select("page_id", "url", "target")


@query("d3_quoted_url_refs", SITE_REFS_SQL + "SELECT page_id, url, target FROM refs WHERE op = 'd3'")
def _(spark, sf_dir):
    return D.quoted_url_refs(site_pages(spark, sf_dir)).select("page_id", "url", "target")


@query("d4_chunk_refs_html", SITE_REFS_SQL + "SELECT page_id, url, target FROM refs WHERE op = 'd4'")
def _(spark, sf_dir):
    return D.chunk_refs_html(site_pages(spark, sf_dir)).select("page_id", "url", "target")


@query(
    "d6_source_map_candidates",
    SITE_REFS_SQL + "SELECT DISTINCT page_id, target FROM refs UNION SELECT page_id, target || '.map' FROM refs WHERE ends_with(target, '.js')",
)
def _(spark, sf_dir):
    return D.page_refs(site_pages(spark, sf_dir))


CHUNK_HOST = "'https://w' || (c_custkey % 20) || '.example.com'"


@query(
    "d5_chunk_refs_js",
    f"""WITH scripts AS (SELECT c_custkey AS asset_id, {CHUNK_HOST} AS host, ['js', 'mjs', 'ts', 'html'][c_custkey % 4 + 1] AS file_type FROM customer),
refs AS (SELECT asset_id, unnest([host || '/js/' || asset_id || '.chunk.js', host || '/js/lib/' || (asset_id + 1) || '.bundle.js', host || '/js/main-' || (asset_id + 3) || '.js',
 'https://cdn.example.net/w' || asset_id || '.js']) AS target FROM scripts WHERE file_type IN ('js', 'mjs'))
SELECT DISTINCT asset_id, target FROM refs WHERE target NOT IN (SELECT host || '/js/main-' || asset_id || '.js' FROM scripts)""",
)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    host = F.concat(F.lit("https://w"), k % 20, F.lit(".example.com"))
    kinds = F.array(*[F.lit(t) for t in ("js", "mjs", "ts", "html")])
    content = F.concat(
        F.lit("load('"), k, F.lit('.chunk.js"); load("'), k, F.lit(".chunk.js'); m[\"lib/"), k + 1, F.lit(".bundle.js\"];\ne.src = '/js/main-"), k + 3,
        F.lit(".js'; importScripts('https://cdn.example.net/w"), k, F.lit(".js')"),
    )
    scripts = table(spark, sf_dir, "customer").select(
        k.alias("asset_id"), F.concat(host, F.lit("/js/main-"), k, F.lit(".js")).alias("url"),
        F.element_at(kinds, (k % 4 + 1).cast("int")).alias("file_type"), content.alias("content"),
    )
    return D.chunk_refs_js(scripts)


# every site starts at its lowest page
CLOSURE_SQL = """WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), edges AS (
 SELECT p_partkey AS src, unnest([p_partkey + 50, p_partkey + 150, p_partkey + 400]) AS dst FROM part),
reach(site, page, depth) AS (SELECT p_partkey % 50, min(p_partkey), 0 FROM part GROUP BY 1
 UNION SELECT site, dst, depth + 1 FROM reach JOIN edges ON src = page WHERE dst < (SELECT n FROM n) AND depth < 19),
nearest AS (SELECT 'w' || site || '.example.com' AS site, 'https://w' || site || '.example.com/p/' || page AS url, min(depth) AS depth FROM reach GROUP BY site, page),
reached AS (SELECT * FROM nearest QUALIFY row_number() OVER (PARTITION BY site ORDER BY depth, url) <= 20)
"""


def site_starts(found: DataFrame) -> DataFrame:
    return found.groupBy(urls.netloc(F.col("url")).alias("site")).agg(F.min_by("url", "page_id").alias("url")).select("url")


@query("d13_link_closure", CLOSURE_SQL + "SELECT site, url, depth::BIGINT AS depth FROM reached")
def _(spark, sf_dir):
    site = site_pages(spark, sf_dir)
    return link_closure(site, site_starts(site), 20)


WHOLE_CLOSURE_SQL = CLOSURE_SQL.replace(" AND depth < 19", "").replace(" QUALIFY row_number() OVER (PARTITION BY site ORDER BY depth, url) <= 20", "")


@query("d13_whole_link_closure", WHOLE_CLOSURE_SQL + "SELECT site, url, depth::BIGINT AS depth FROM reached")
def _(spark, sf_dir):
    """Everything that links lead to, whatever the number of pages of a site."""
    site = site_pages(spark, sf_dir)
    return link_closure(site, site_starts(site))


@query(
    "d14_closure_static_refs",
    CLOSURE_SQL + ", " + SITE_REFS_SQL.replace("WITH ", "", 1).replace("site AS", "site_page AS").replace("FROM site)", "FROM site_page)").replace("FROM site\n", "FROM site_page\n").replace("AS form FROM site)", "AS form FROM site_page)")
    + "SELECT DISTINCT r.site, f.target FROM reached r JOIN refs f USING (url) WHERE op = 'd3' OR (op = 'd1' AND kind IN ('script', 'link'))",
)
def _(spark, sf_dir):
    site = site_pages(spark, sf_dir)
    return closure_static_refs(site, link_closure(site, site_starts(site), 20))


# -- single-page applications --------------------------------------------------------------

SHELLS: list[tuple[str, bool, int]] = [  # markup, is_spa, framework markers
    ('<body><div id="root"></div><script src="/react-dom.js"></script></body>', True, 1),
    ('<body><div id="root">{text}{text}</div></body>', False, 0),
    ("<body><noscript>Please enable JavaScript</noscript><p>short</p></body>", True, 0),
    ("<body><noscript>Please enable JavaScript</noscript><p>{text}{text}{text}{text}</p></body>", False, 0),
    ("<body><p>tiny</p><script>createApp(App); window.__NUXT__ = '{pad}'</script></body>", True, 4),
    ("<body><p>tiny</p><script>plain('{pad}')</script></body>", False, 0),
    ("<p>no body {text}</p>", False, 0),
    ('<body><my-app ng-version="15"><br>hi</my-app><script>{text}</script></body>', True, 0),
]
TEXT = "All of this is visible text of the page, written out in words to read. "
PAD = "x" * 2100


def shell_markup(i: int) -> str:
    return SHELLS[i][0].replace("{text}", TEXT).replace("{pad}", PAD)


@query(
    "d15_spa_flag",
    "SELECT c_custkey AS page_id, ['" + "', '".join(str(s).lower() for _, s, _ in SHELLS) + f"'][c_custkey % {len(SHELLS)} + 1] = 'true' AS is_spa, "
    f"[{', '.join(str(m) for _, _, m in SHELLS)}][c_custkey % {len(SHELLS)} + 1]::BIGINT AS markers FROM customer",
)
def _(spark, sf_dir):
    return D.spa_flag(shells(spark, sf_dir)).select("page_id", "is_spa", "markers")


def shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    forms = strings([shell_markup(i) for i in range(len(SHELLS))])
    return table(spark, sf_dir, "customer").select(
        k.alias("page_id"), F.concat(F.lit("https://w/"), k).alias("url"),
        F.concat(F.lit("<html><head><title>"), "c_name", F.lit("</title></head>"), F.element_at(forms, (k % len(SHELLS) + 1).cast("int")), F.lit("</html>")).alias("html"),
    )


@query(
    "d16_framework_markers",
    f"SELECT c_custkey AS page_id, [{', '.join(str(m) for _, _, m in SHELLS)}][c_custkey % {len(SHELLS)} + 1]::BIGINT AS markers FROM customer",
)
def _(spark, sf_dir):
    return shells(spark, sf_dir).select("page_id", D.framework_markers(F.col("html")).alias("markers"))


# -- captured requests -------------------------------------------------------------------------

TYPES = {"view": "script", "click": "xhr", "purchase": "fetch", "signup": "stylesheet", "error": "image"}
REQUEST_URL = "'https://api' || (user_id % 30) || '.example.com/v1/' || event_type || '/' || (event_id % 40) || CASE WHEN event_id % 7 = 0 THEN '.js' ELSE '' END || '?k=' || (event_id % 3)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(r)) for t, r in TYPES.items()])
    url = F.concat(
        F.lit("https://api"), F.col("user_id") % 30, F.lit(".example.com/v1/"), "event_type", F.lit("/"), e % 40,
        F.when(e % 7 == 0, ".js").otherwise(""), F.lit("?k="), e % 3,
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://w"), F.col("user_id") % 30, F.lit(".example.com/")).alias("page_url"), url.alias("url"),
        F.when(F.col("event_type") == "purchase", "post").alias("method"), kind.alias("resource_type"),
    )


TYPE_SQL = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{r}'" for t, r in TYPES.items()) + " END"


@query(
    "s5_load_requests",
    f"""SELECT 'https://w' || (user_id % 30) || '.example.com/' AS page_url, {REQUEST_URL} AS url, CASE WHEN event_type = 'purchase' THEN 'post' END AS method,
 {TYPE_SQL} AS resource_type, {TYPE_SQL} || '/*' AS accept FROM events""",
)
def _(spark, sf_dir):
    """A network log written as JSON lines and read with its schema."""
    folder = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    headers = F.create_map(F.lit("accept"), F.concat("resource_type", F.lit("/*")))
    requests(spark, sf_dir).withColumn("headers", headers).write.json(folder)
    return load_requests(spark, folder).withColumn("accept", F.col("headers")["accept"]).drop("headers")


@query(
    "d18_runtime_static_urls",
    f"""SELECT DISTINCT 'https://w' || (user_id % 30) || '.example.com/' AS page_url, {REQUEST_URL} AS target FROM events WHERE event_type <> 'error'
 UNION SELECT url, target FROM ({SITE_REFS_SQL} SELECT url, target FROM refs WHERE op = 'd3')""",
)
def _(spark, sf_dir):
    return D.runtime_static_urls(requests(spark, sf_dir), site_pages(spark, sf_dir))


RUNTIME_SQL = """SELECT DISTINCT CASE event_type WHEN 'purchase' THEN 'POST' ELSE 'GET' END || ' /v1/' || event_type || '/' || (event_id % 40) AS endpoint
 FROM events WHERE event_type IN ('click', 'purchase') AND event_id % 7 <> 0"""


@query("d19_runtime_endpoints", RUNTIME_SQL)
def _(spark, sf_dir):
    return D.runtime_endpoints(requests(spark, sf_dir))


@query(
    "e11_all_endpoints",
    ENDPOINT_SQL + f"SELECT DISTINCT method || ' ' || url AS endpoint FROM endpoints UNION {RUNTIME_SQL} UNION SELECT 'GET /m/' || turn FROM conversations WHERE conv_id % 5 IN (0, 1)",
)
def _(spark, sf_dir):
    reported = response_endpoints(parse_responses(responses_table(spark, sf_dir)))
    return endpoint_set(
        endpoint_names(endpoints(files(spark, sf_dir))), D.runtime_endpoints(requests(spark, sf_dir)), reported
    )


@query(
    "x5_endpoints_diff",
    ENDPOINT_SQL + f""", old AS (SELECT DISTINCT method || ' ' || url AS endpoint FROM endpoints), new AS ({RUNTIME_SQL} UNION SELECT endpoint FROM old WHERE NOT starts_with(endpoint, 'PUT'))
 SELECT endpoint, 'added' AS change FROM (SELECT * FROM new EXCEPT SELECT * FROM old) UNION ALL SELECT endpoint, 'removed' FROM (SELECT * FROM old EXCEPT SELECT * FROM new)""",
)
def _(spark, sf_dir):
    old = endpoint_set(endpoint_names(endpoints(files(spark, sf_dir))))
    new = endpoint_set(D.runtime_endpoints(requests(spark, sf_dir)), old.where(~F.col("endpoint").startswith("PUT")))
    return diff_sets(old, new, ["endpoint"])


# -- hosts ------------------------------------------------------------------------------------

HOST_FORMS: list[tuple[str, str]] = [  # host with {a} in 0…255, expected reason
    ("10.{a}.0.1", "Private/internal IP: 10.{a}.0.1 (10.0.0.0/8)"),
    ("172.16.{a}.9", "Private/internal IP: 172.16.{a}.9 (172.16.0.0/12)"),
    ("172.32.{a}.9", ""),
    ("192.168.{a}.255:8080", "Private/internal IP: 192.168.{a}.255 (192.168.0.0/16)"),
    ("169.254.169.254", "Blocked IP (cloud metadata): 169.254.169.254"),
    ("100.127.{a}.1", "Private/internal IP: 100.127.{a}.1 (100.64.0.0/10)"),
    ("100.128.{a}.1", ""),
    ("198.19.{a}.1", "Private/internal IP: 198.19.{a}.1 (198.18.0.0/15)"),
    ("0.{a}.0.1", "Private/internal IP: 0.{a}.0.1 (0.0.0.0/8)"),
    ("user:pw@127.0.{a}.1", "Private/internal IP: 127.0.{a}.1 (127.0.0.0/8)"),
    ("LocalHost", "Blocked hostname: localhost"),
    ("n{a}.metadata.internal", "Blocked hostname: n{a}.metadata.internal"),
    ("shop{a}.example.com", ""),
    ("[::1]:80", "Private/internal IP: ::1 (::1/128)"),
    ("[fd00:ec2::254]", "Blocked IP (cloud metadata): fd00:ec2::254"),
    ("[fe80::{a}]", "Private/internal IP: fe80::{a} (fe80::/10)"),
    ("[2001:db8::1]", ""),
    ("", "No hostname in URL"),
    ("127.1", "Private/internal IP: 127.0.0.1 (127.0.0.0/8)"),
    ("2130706433", "Private/internal IP: 127.0.0.1 (127.0.0.0/8)"),
    ("0x7f.0.0.{a}", "Private/internal IP: 127.0.0.{a} (127.0.0.0/8)"),
    ("010.0.0.{a}", ""),
    ("256.1.1.{a}", ""),
]


@query(
    "d20_classify_host",
    f"""WITH f(i, host, reason) AS (VALUES {', '.join(f'({i}, {quote(h)}, {quote(r)})' for i, (h, r) in enumerate(HOST_FORMS))})
SELECT o_orderkey AS id, 'http://' || replace(host, '{{a}}', (o_custkey % 100 + 100)::VARCHAR) || '/x?y' AS url,
 reason = '' AS allowed, replace(reason, '{{a}}', (o_custkey % 100 + 100)::VARCHAR) AS reason FROM orders JOIN f ON i = o_orderkey % {len(HOST_FORMS)}""",
)
def _(spark, sf_dir):
    hosts = strings([h for h, _ in HOST_FORMS])
    host = F.element_at(hosts, (F.col("o_orderkey") % len(HOST_FORMS) + 1).cast("int"))
    number = (F.col("o_custkey") % 100 + 100).cast("string")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("http://"), F.replace(host, F.lit("{a}"), number), F.lit("/x?y")).alias("url")
    )
    return classify_host(rows)


# -- dependencies of two scans --------------------------------------------------------------------

@query(
    "x6_dependencies_diff",
    """WITH old AS (SELECT DISTINCT 'lib' || (l_partkey % 50) AS name, (l_linenumber % 4) || '.0' AS version FROM lineitem WHERE l_returnflag = 'R'),
new AS (SELECT DISTINCT 'lib' || (l_partkey % 60) AS name, (l_linenumber % 3) || '.0' AS version FROM lineitem WHERE l_returnflag <> 'R')
SELECT name, version, 'added' AS change FROM (SELECT * FROM new EXCEPT SELECT * FROM old) UNION ALL SELECT name, version, 'removed' FROM (SELECT * FROM old EXCEPT SELECT * FROM new)""",
)
def _(spark, sf_dir):
    def deps(rows: DataFrame, libs: int, majors: int) -> DataFrame:
        return rows.select(F.concat(F.lit("lib"), F.col("l_partkey") % libs).alias("name"), F.concat(F.col("l_linenumber") % majors, F.lit(".0")).alias("version"))

    items = table(spark, sf_dir, "lineitem")
    returned = F.col("l_returnflag") == "R"
    return diff_sets(deps(items.where(returned), 50, 4), deps(items.where(~returned), 60, 3), ["name", "version"])
