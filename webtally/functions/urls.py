"""URL splitting, joining and classification as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, strings
from ..catalog.paths import STATIC_EXTENSIONS, UNFOLLOWED_SUBSTRINGS, UNFOLLOWED_SUFFIXES

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def clean(url: Column) -> Column:
    """Drop leading control characters and spaces and all tabs and line breaks."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def parts(url: Column) -> Column:
    """``struct<scheme, net, path, query, fragment>``; missing parts are ''."""

    def split(u: Column) -> Column:
        def group(k: int) -> Column:
            return F.regexp_extract(u, _PARTS, k)

        return F.struct(
            F.lower(group(1)).alias("scheme"), group(2).alias("net"), group(3).alias("path"),
            group(4).alias("query"), group(5).alias("fragment"),
        )

    return let(clean(url), split)


def _without_params(path_text: Column) -> Column:
    return F.regexp_replace(path_text, r";[^/]*$", "")


def netloc(url: Column) -> Column:
    """Authority with user info and port, '' if there is none."""
    return F.regexp_extract(clean(url), _PARTS, 2)


def path(url: Column) -> Column:
    """Path without the ``;params`` of its last segment."""
    return _without_params(F.regexp_extract(clean(url), _PARTS, 3))


def origin(url: Column) -> Column:
    return let(parts(url), lambda p: F.concat(p.getField("scheme"), F.lit("://"), p.getField("net")))


def hostname(url: Column) -> Column:
    """Lower-cased host without user info, port and brackets; NULL if missing."""

    def bare(host: Column) -> Column:
        name = F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(
            F.regexp_extract(host, r"^([^:]*)", 1)
        )
        return F.nullif(F.lower(name), F.lit(""))

    return let(F.regexp_replace(netloc(url), r"^.*@", ""), bare)


def _prefixed(mark: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(mark), text)).otherwise("")


def _remove_dots(joined: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""

    def walk(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))

    return let(F.split(F.substring(joined, 2, 1 << 30), "/", -1), walk)


def resolve_url(base: Column, ref: Column) -> Column:
    """Resolve a reference against the URL of the document it stands in."""

    def join(args: Column) -> Column:
        raw_base, raw_ref = args.getField("base"), args.getField("ref")
        b, r = args.getField("b"), args.getField("r")
        ref_path = r.getField("path")
        rooted = ref_path.startswith("/")
        has_net, has_path = r.getField("net") != "", ref_path != ""

        folder = F.regexp_replace(b.getField("path"), r"[^/]*$", "")
        relative = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), ref_path)
        joined = F.when(rooted, ref_path).otherwise(F.regexp_replace(relative, "/+", "/"))
        merged = let(joined, lambda p: F.when(p.rlike(r"/\.\.?(/|$)"), _remove_dots(p)).otherwise(p))
        net_path = F.when(has_path & ~rooted, F.concat(F.lit("/"), ref_path)).otherwise(ref_path)

        out_path = F.when(has_net, net_path).when(has_path, merged).otherwise(b.getField("path"))
        own_query = has_net | has_path | (r.getField("query") != "")
        built = F.concat(
            F.coalesce(F.nullif(r.getField("scheme"), F.lit("")), b.getField("scheme")), F.lit("://"),
            F.when(has_net, r.getField("net")).otherwise(b.getField("net")), out_path,
            _prefixed("?", F.when(own_query, r.getField("query")).otherwise(b.getField("query"))),
            _prefixed("#", r.getField("fragment")),
        )
        foreign = (r.getField("scheme") != "") & (r.getField("scheme") != b.getField("scheme"))
        return F.when(raw_ref == "", raw_base).when((raw_base == "") | foreign, raw_ref).otherwise(built)

    args = F.struct(base.alias("base"), ref.alias("ref"), parts(base).alias("b"), parts(ref).alias("r"))
    return let(args, join)


def drop_fragment(url: Column) -> Column:
    """An absolute URL without fragment and path parameters; the query stays."""
    return let(
        parts(url),
        lambda p: F.concat(
            p.getField("scheme"), F.lit("://"), p.getField("net"), _without_params(p.getField("path")),
            _prefixed("?", p.getField("query")),
        ),
    )


def normalize_url(base: Column, url: Column) -> Column:
    """Absolute form without fragment and path parameters."""
    return drop_fragment(resolve_url(base, url))


def same_origin(url: Column, base_netloc: Column) -> Column:
    return let(netloc(url), lambda net: (net == base_netloc) | (net == ""))


def should_follow(url: Column, base_netloc: Column) -> Column:
    """Same origin, no static suffix, no noise."""
    suffixes = strings(UNFOLLOWED_SUFFIXES)
    noise = strings(UNFOLLOWED_SUBSTRINGS)

    def keep(args: Column) -> Column:
        net, lower_path, lower_url = (args.getField(f) for f in ("net", "path", "url"))
        return (
            ((net == args.getField("base")) | (net == ""))
            & ~F.exists(suffixes, lambda s: F.endswith(lower_path, s))
            & ~F.exists(noise, lambda s: F.contains(lower_url, s))
        )

    args = F.struct(
        netloc(url).alias("net"), F.lower(path(url)).alias("path"), F.lower(url).alias("url"), base_netloc.alias("base")
    )
    return let(args, keep)


def suffix(url: Column) -> Column:
    """Lower-cased suffix of the last path segment without dot; '' for none and for dot-files."""
    return F.lower(F.regexp_extract(path(url), r"[^/]\.([^./]+)/*$", 1))


def file_type(url: Column) -> Column:
    return F.coalesce(F.nullif(suffix(url), F.lit("")), F.lit("unknown"))


def has_static_suffix(url: Column) -> Column:
    return suffix(url).isin(STATIC_EXTENSIONS)
