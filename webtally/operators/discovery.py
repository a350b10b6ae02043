"""References, links and pages found in HTML and script text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..catalog import code
from ..catalog.paths import FRAMEWORK_MARKERS, SENSITIVE_PATHS
from ..functions import dialect, urls
from ..functions.normalize import unescape_html
from ..functions.text import explode_structs, extract_all, let, strings

# Tags and attributes that reference another resource.
REFERENCE_ATTRIBUTES: list[tuple[str, str]] = [
    ("script", "src"), ("link", "href"), ("form", "action"), ("img", "src"),
    ("iframe", "src"), ("embed", "src"), ("object", "data"),
]

_ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


# -- tags ------------------------------------------------------------------

def visible_markup(html: Column) -> Column:
    """HTML without comments and without the text of scripts and styles."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(bare, r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>)", "$1$3")


def tag_attributes(markup: Column, tag: str) -> Column:
    """Attribute text of every opening tag; quoted values may hold ``>``."""
    return extract_all(markup, rf"""(?is)<{tag}(?=[\s/>])((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")


def attribute(attributes: Column, name: str) -> Column:
    """Value of an attribute, NULL if absent; the last of several counts."""
    pairs = F.arrays_zip(*[extract_all(attributes, _ATTRIBUTE, g) for g in (1, 2, 3, 4)])
    named = F.filter(pairs, lambda p: F.lower(p.getField("0")) == name)
    return F.get(
        F.transform(named, lambda p: F.concat(p.getField("1"), p.getField("2"), p.getField("3"))),
        F.size(named) - 1,
    )


def attribute_values(markup: Column, tag: str, name: str) -> Column:
    values = F.transform(tag_attributes(markup, tag), lambda a: attribute(a, name))
    return F.filter(values, lambda v: v.isNotNull())


def _tagged(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("ref")))


def _with_targets(refs: Column, base: Column, target: Callable[[Column, Column], Column] = urls.resolve_url, unescape: bool = False) -> Column:
    """Different references (kind, ref) with their targets, without repeats; decoding and resolving stay in the row."""

    def one(kind: Column, ref: Column) -> Column:
        return F.struct(kind.alias("kind"), ref.alias("ref"), target(base, ref).alias("target"))

    def located(r: Column) -> Column:
        return let(unescape_html(r.getField("ref")) if unescape else r.getField("ref"), lambda ref: one(r.getField("kind"), ref))

    return F.array_distinct(F.transform(F.array_distinct(refs), located))


def _explode_refs(pages: DataFrame, refs: Column) -> DataFrame:
    return explode_structs(pages.select("page_id", "url", refs.alias("_refs")), "_refs", "page_id", "url")


# -- references --------------------------------------------------------------
# The functions of columns give the references of one page as an array: one projection, and no row leaves its page.

def tag_references(markup: Column, url: Column) -> Column:
    refs = F.concat(*[_tagged(attribute_values(markup, t, a), t) for t, a in REFERENCE_ATTRIBUTES])
    return _with_targets(refs, url, unescape=True)


def refresh_references(markup: Column, url: Column) -> Column:
    def of_tag(a: Column) -> Column:
        content = F.coalesce(attribute(a, "content"), F.lit(""))
        target = F.trim(F.regexp_extract(content, r"(?id)url=(.+)", 1), F.lit("'\""))
        return F.when((attribute(a, "http-equiv") == "refresh") & content.rlike(r"(?id)url=."), target)

    found = F.filter(F.transform(tag_attributes(markup, "meta"), of_tag), lambda r: r.isNotNull())
    return _with_targets(_tagged(found, "meta"), url, unescape=True)


def quoted_references(html: Column, url: Column) -> Column:
    def target(base: Column, ref: Column) -> Column:
        return F.when(ref.startswith("/"), urls.resolve_url(base, ref)).otherwise(ref)

    return _with_targets(_tagged(extract_all(html, dialect.java(code.QUOTED_URL)), "quoted"), url, target)


def chunk_references(html: Column, url: Column) -> Column:
    found = F.concat(*[extract_all(html, dialect.java(p)) for p in code.HTML_CHUNKS])
    return let(urls.origin(url), lambda root: _with_targets(_tagged(found, "chunk"), root))


def with_source_maps(targets: Column) -> Column:
    """The targets and the ``.map`` sibling of every script among them, without repeats."""
    scripts = F.filter(targets, lambda t: t.endswith(".js"))
    return F.array_distinct(F.concat(targets, F.transform(scripts, lambda t: F.concat(t, F.lit(".map")))))


def html_refs(pages: DataFrame) -> DataFrame:
    """Attribute references by tag, with their absolute target, once for each row of ``pages``."""
    return _explode_refs(pages, let(visible_markup(F.col("html")), lambda m: tag_references(m, F.col("url"))))


def meta_refresh_refs(pages: DataFrame) -> DataFrame:
    """Target of ``<meta http-equiv="refresh">``, once for each row of ``pages``."""
    return _explode_refs(pages, let(visible_markup(F.col("html")), lambda m: refresh_references(m, F.col("url"))))


def quoted_url_refs(pages: DataFrame) -> DataFrame:
    """Quoted absolute URLs and root paths with a suffix, anywhere in the text (D3)."""
    return _explode_refs(pages, quoted_references(F.col("html"), F.col("url")))


def chunk_refs_html(pages: DataFrame) -> DataFrame:
    """Bundle and chunk names in a page, resolved against the site root."""
    return _explode_refs(pages, chunk_references(F.col("html"), F.col("url")))


def chunk_refs_js(assets: DataFrame) -> DataFrame:
    """Chunks named in scripts that are not among the known URLs yet."""
    found = F.array_distinct(F.concat(*[extract_all(F.col("content"), dialect.java(p)) for p in code.SCRIPT_CHUNKS]))
    scripts = assets.where(F.col("file_type").isin("js", "mjs")).select(
        "asset_id", "url", F.explode_outer(found).alias("ref")
    ).where(F.col("ref").isNotNull())
    target = F.when(F.col("ref").startswith("http"), F.col("ref")).otherwise(
        urls.resolve_url(F.col("url"), F.col("ref"))
    )
    refs = scripts.select("asset_id", target.alias("target")).distinct()
    return refs.join(assets.select(F.col("url").alias("target")).distinct(), "target", "left_anti")


def source_map_candidates(refs: DataFrame) -> DataFrame:
    """Add the ``.map`` sibling of every script target."""
    return refs.select("page_id", F.explode(with_source_maps(F.array("target"))).alias("target")).distinct()


def page_refs(pages: DataFrame) -> DataFrame:
    """All different references of each row of ``pages``: tags, refresh, quoted, chunks and source maps, read in one pass."""
    html, url = F.col("html"), F.col("url")
    marked = let(visible_markup(html), lambda m: F.concat(tag_references(m, url), refresh_references(m, url)))
    refs = F.concat(marked, quoted_references(html, url), chunk_references(html, url))
    targets = let(F.transform(refs, lambda r: r.getField("target")), with_source_maps)
    return pages.select("page_id", F.explode_outer(targets).alias("target")).where(F.col("target").isNotNull())


def interesting_refs(refs: DataFrame, paths: Sequence[str] = SENSITIVE_PATHS) -> DataFrame:
    """References to text assets or to a sensitive path."""

    # bound, or a target that is itself an expression would be computed again for every path
    def interesting(url: Column) -> Column:
        return urls.has_static_suffix(url) | F.exists(strings(paths), lambda p: F.contains(url, p))

    return refs.where(let(F.col("target"), interesting))


def sensitive_path_match(found: DataFrame, paths: Sequence[str] = SENSITIVE_PATHS, exact: bool = False) -> DataFrame:
    """One row per stored URL and sensitive path: substring, or equality of the URL path.

    The path list is a constant array searched inside the row; there is no join.
    """
    subject = urls.path(F.col("target")) if exact else F.col("target")
    test = (lambda s, p: s == p) if exact else F.contains
    hits = let(subject, lambda s: F.filter(strings(paths), lambda p: test(s, p)))
    return found.select(*found.columns, F.explode_outer(hits).alias("path")).where(F.col("path").isNotNull())


# -- links -------------------------------------------------------------------

def page_links(pages: DataFrame) -> DataFrame:
    """Different followable links of each row of ``pages``: ``<a href>`` and script navigation."""
    anchors = let(
        visible_markup(F.col("html")),
        # only attribute values are entity-encoded; script strings are taken as they stand
        lambda markup: F.transform(F.array_distinct(attribute_values(markup, "a", "href")), unescape_html),
    )
    refs = F.concat(anchors, *[extract_all(F.col("html"), dialect.java(p)) for p in code.NAVIGATION])

    def followed(site: Column) -> Column:
        def of(ref: Column) -> Column:
            return let(
                urls.resolve_url(F.col("url"), ref),
                lambda target: let(urls.drop_fragment(target), lambda link: F.when(urls.should_follow(link, site), link)),
            )

        return F.array_distinct(F.transform(F.array_distinct(refs), of))

    links = let(urls.netloc(F.col("url")), followed)
    return pages.select("page_id", "url", F.explode_outer(links).alias("link")).where(F.col("link").isNotNull())


# -- single-page applications --------------------------------------------------

def framework_markers(html: Column) -> Column:
    """How many of the framework markers occur in the scripts of the body."""
    body = F.regexp_extract(html, r"(?is)<body\b(.*)$", 1)

    def count(parts: Column) -> Column:
        texts = extract_all(parts, r"(?is)<script\b[^>]*>(.*?)</script\s*>")
        combined = F.lower(F.concat(F.array_join(texts, " "), F.array_join(attribute_values(parts, "script", "src"), " ")))
        return let(
            combined,
            lambda text: F.size(F.filter(strings([m.lower() for m in FRAMEWORK_MARKERS]), lambda m: F.contains(text, m))),
        )

    return let(body, count)


class _TextLengths(HTMLParser):
    """Visible text lengths of the body and of application root elements."""

    VOID = frozenset([
        "area",
        "base",
        "br",
        "col",
        "embed",
        "hr",
        "img",
        "input",
        "keygen",
        "link",
        "menuitem",
        "meta",
        "param",
        "source",
        "track",
        "wbr",
        "basefont",
        "bgsound",
        "command",
        "frame",
        "image",
        "isindex",
        "nextid",
        "spacer",
    ])
    SILENT = frozenset(["script", "style", "template"])
    # Ids, id parts, tags and attributes of application roots.
    ROOT_IDS = frozenset(["root", "app", "__next", "__nuxt"])
    ROOT_ID_PARTS = ("react", "angular", "vue")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = []  # [tag, is_root, text length before it]
        self.open_tags: Counter[str] = Counter()
        self.total = 0
        self.body: list | None = None
        self.body_chars = 0
        self.in_body = self.in_noscript = False
        self.roots: list[int] = []
        self.noscript: list | None = None
        self.noscript_text: list[str] = []
        self.buffer: list[str] = []

    def flush(self) -> None:
        text = "".join(self.buffer).strip()
        self.buffer.clear()
        if not text or (self.stack and self.stack[-1][0] in self.SILENT):
            return
        self.total += len(text)
        if self.in_noscript:
            self.noscript_text.append(text)

    def handle_starttag(self, tag, attrs) -> None:
        self.flush()
        named = {k: v or "" for k, v in attrs}
        inside = self.in_body
        ident = named.get("id", "")
        root = inside and (
            ident in self.ROOT_IDS or any(p in ident for p in self.ROOT_ID_PARTS)
            or tag == "app-root" or "ng-version" in named
        )
        frame = [tag, root, self.total]
        if tag in self.VOID:
            if root:
                self.roots.append(0)
            return
        if tag == "body" and self.body is None:
            self.body, self.in_body = frame, True
        if tag == "noscript" and inside and self.noscript is None:
            self.noscript, self.in_noscript = frame, True
        self.stack.append(frame)
        self.open_tags[tag] += 1

    def handle_endtag(self, tag) -> None:
        self.flush()
        if self.open_tags[tag]:
            while self.close_last() != tag:
                pass

    def close_last(self) -> str:
        frame = self.stack.pop()
        tag, root, before = frame
        self.open_tags[tag] -= 1
        if root:
            self.roots.append(self.total - before)
        if frame is self.body:
            self.body_chars, self.in_body = self.total - before, False
        if frame is self.noscript:
            self.in_noscript = False
        return tag

    def handle_data(self, data) -> None:
        self.buffer.append(data)

    def handle_comment(self, data) -> None:
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def result(self) -> dict:
        self.close()
        self.flush()
        while self.stack:
            self.close_last()
        hint = "".join(self.noscript_text).lower()
        return {
            "has_body": self.body is not None,
            "min_root": min(self.roots) if self.roots else None,
            "body_chars": self.body_chars,
            "noscript_hint": any(k in hint for k in ("javascript", "enable", "browser")),
        }


_LENGTHS = T.StructType(
    [
        T.StructField("has_body", T.BooleanType()), T.StructField("min_root", T.IntegerType()),
        T.StructField("body_chars", T.IntegerType()), T.StructField("noscript_hint", T.BooleanType()),
    ]
)


@F.pandas_udf(_LENGTHS)
def text_lengths(html: pd.Series) -> pd.DataFrame:
    rows = []
    for text in html:
        parser = _TextLengths()
        parser.feed(text or "")
        rows.append(parser.result())
    out = pd.DataFrame(rows, columns=["has_body", "min_root", "body_chars", "noscript_hint"])
    return out.astype({"min_root": "Int32", "body_chars": "int32"})


def spa_flag(pages: DataFrame) -> DataFrame:
    """Pages whose visible content is rendered by script."""
    measured = pages.select(
        "page_id", "url", F.length("html").alias("html_chars"),
        framework_markers(F.col("html")).alias("markers"), text_lengths("html").alias("t"),
    )
    empty_root = F.coalesce(F.col("t.min_root") < 50, F.lit(False))
    thin_body = (F.col("t.body_chars") < 200) & (F.col("html_chars") > 2000) & (F.col("markers") >= 1)
    asks_for_script = F.col("t.noscript_hint") & (F.col("t.body_chars") < 300)
    return measured.select(
        "page_id", "url", "markers", F.col("t.body_chars").alias("body_chars"),
        (F.col("t.has_body") & (empty_root | thin_body | asks_for_script)).alias("is_spa"),
    )


# -- captured requests ---------------------------------------------------------

# Request types and path suffixes of a captured network log.
STATIC_REQUEST_TYPES = ["script", "stylesheet", "fetch", "xhr", "other"]
DATA_REQUEST_TYPES = ["fetch", "xhr"]
STATIC_REQUEST_SUFFIXES = [".js", ".css", ".png", ".jpg", ".svg", ".ico", ".woff"]


def runtime_static_urls(requests: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """Distinct URLs a page loaded, plus quoted URLs of its rendered HTML."""
    loaded = requests.where(F.col("resource_type").isin(STATIC_REQUEST_TYPES) & (F.col("url") != ""))
    found = loaded.select("page_url", F.col("url").alias("target"))
    if rendered is not None:
        found = found.unionByName(quoted_url_refs(rendered).select(F.col("url").alias("page_url"), "target"))
    return found.distinct()


def runtime_endpoints(requests: DataFrame) -> DataFrame:
    """Distinct ``METHOD path`` of data requests, static suffixes dropped."""
    path = urls.path(F.col("url"))
    data = requests.where(F.col("resource_type").isin(DATA_REQUEST_TYPES) & (path != ""))
    for suffix in STATIC_REQUEST_SUFFIXES:
        data = data.where(~path.endswith(suffix))
    method = F.upper(F.coalesce("method", F.lit("GET")))
    return data.select(F.concat_ws(" ", method, path).alias("endpoint")).distinct()


