"""Column functions against the standard library or hand-made values."""

import itertools
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from webtally.functions import normalize as N
from webtally.functions import urls
from webtally.functions.versions import version_below
from webtally.operators import discovery as D
from webtally.operators.normalization import normalize_content

BASES = ["http://h/a/b?x=1#f", "http://h", "http://h/", "https://u@h:80/a/b/c/", "http://h/a;p/b;q?y"]
REFS = [
    "", "x", "../x", "../../../x", "/x//y", "//o/z", "//o", "?q", "#f", "./", ".", "..", "/..", "/a/../b/./c", "mailto:a@b",
    "http:foo", "HTTP://X/y", "a/b/../c/", "x?y=/../z", "\tx y", "javascript:void(0)", "https://z/é?ü#ö", "a//b", "x;p=1", "g;x=1/../y",
]


def test_resolve_url(spark):
    pairs = list(itertools.product(BASES, REFS))
    df = spark.createDataFrame(pairs, "b string, r string").withColumn("o", urls.resolve_url(F.col("b"), F.col("r")))
    assert [(r.b, r.r, r.o) for r in df.collect()] == [(b, r, urljoin(b, r)) for b, r in pairs]


def test_url_parts(spark):
    values = ["http://u:p@Host.Example:8080/a/b.JS;v=1?q=/x.css#y", "http://h/.env", "http://h/a.tar.gz/", "https://[::1]:8/x", "/only/path", "http://h", "http:///x", "http://h/..js", "http://h/foo."]
    df = spark.createDataFrame([(v,) for v in values], "u string").select(
        "u", urls.netloc(F.col("u")).alias("n"), urls.path(F.col("u")).alias("p"), urls.hostname(F.col("u")).alias("h"), urls.suffix(F.col("u")).alias("s")
    )
    rows = df.collect()
    assert [(r.n, r.p, r.h) for r in rows] == [(urlparse(v).netloc, urlparse(v).path, urlparse(v).hostname) for v in values]
    assert [r.s for r in rows] == ["js", "", "gz", "", "", "", "", "js", ""]


@pytest.mark.parametrize(
    "url, follow",
    [("http://h/a", True), ("http://h/a.JS", False), ("http://o/a", False), ("http://h/wp-content/x", False), ("http://h/a#b", False), ("http://h/?d=data:1", False), ("http://h/x.css?y", False), ("/rel", True)],
)
def test_should_follow(spark, url, follow):
    df = spark.createDataFrame([(url,)], "u string").select(urls.should_follow(F.col("u"), F.lit("h")).alias("f"))
    assert df.first().f is follow


def apply(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("o", fn(F.col("t")))
    return [r.o for r in df.orderBy("i").collect()]


def test_decode_hex(spark):
    assert apply(spark, N.decode_hex, r"a\x41\x42-\xZZ", "plain", "", r"\xe9\x0a") == [r"aAB-\xZZ", "plain", "", "é\n"]


def test_decode_unicode(spark):
    bs = "\\"
    texts = [f"{bs}u20AC {bs}uD83D{bs}uDE00 {bs}u{{1F600}}", f"{bs}uD83D x {bs}uDE00", f"{bs}u{{110000}} {bs}u{{D800}} {bs}u{{41}}", "none"]
    assert apply(spark, N.decode_unicode, *texts) == ["€ 😀 😀", f"{bs}uD83D x {bs}uDE00", f"{bs}u{{110000}} {bs}u{{D800}} A", "none"]


def test_long_inputs(spark):
    """Runs and tags far beyond what a recursive match could hold."""
    bs = "\\"
    assert apply(spark, N.decode_unicode, f"{bs}u0416" * 100_000) == ["Ж" * 100_000]
    assert apply(spark, N.decode_hex, f"{bs}x41" * 100_000) == ["A" * 100_000]
    wide = "<a " + 'k="v" ' * 50_000 + 'href="/end">'
    found = spark.createDataFrame([(wide,)], "t string").select(D.attribute_values(F.col("t"), "a", "href").alias("v"))
    assert found.first().v == ["/end"]


def test_decode_base64(spark):
    got = apply(spark, N.decode_base64_literals, 'atob("aGVsbG8gd29ybGQ=")', "atob('/////////w==')", 'atob("short")', 'atob("abcdefghi")')
    assert got == ['/* b64decoded: */ "hello world"', "atob('/////////w==')", 'atob("short")', 'atob("abcdefghi")']


def test_join_literals(spark):
    chain = " + ".join(f'"{i}"' for i in range(600))
    texts = [chain, "'a' + \"b\" + \"c\"", '"x" + "y" + \'a\' + "b" + "c"', "1 + 2", "'it' + 's'"]
    want = ['"' + "".join(map(str, range(600))) + '"', "'a' + \"b\" + \"c\"", '"xy" + \'a\' + "bc"', "1 + 2", "'its'"]
    assert apply(spark, N.join_string_literals, *texts) == want


def test_normalize_by_type(spark):
    rows = [(1, "html", "&amp;lt; \\x41"), (2, "js", "&amp; \\x41"), (3, "css", "&amp; \\x41")]
    df = normalize_content(spark.createDataFrame(rows, "asset_id int, file_type string, content string"))
    assert [r.content for r in df.orderBy("asset_id").collect()] == ["&lt; A", "&amp; A", "&amp; \\x41"]


@pytest.mark.parametrize(
    "version, below, expected",
    [("3.4.1", "3.5.0", True), ("3.5", "3.5.0", True), ("3.5.0", "3.5.0", False), ("^1.2", "1.10", True), ("v2.0.0-beta", "2.0.0", False),
     ("1.x", "2.0", False), ("", "1.0", False), ("^^1.0", "2.0", False), ("10.0.0", "9.9.9", False), ("1.2.3.x", "1.2.4", True)],
)
def test_version_below(spark, version, below, expected):
    df = spark.createDataFrame([(version, below)], "v string, t string").select(version_below(F.col("v"), F.col("t")).alias("b"))
    assert df.first().b is expected
