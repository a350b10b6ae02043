"""Native entity decoding against the standard library."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from webtally.functions.normalize import unescape_html


def check(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", unescape_html(F.col("t")).alias("u")).collect()
    got = {r["i"]: r["u"] for r in rows}
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if t is not None and got[i] != html.unescape(t)]
    assert not wrong, wrong[:5]
    return got


def test_every_name(spark):
    texts = [f"a&{n}b" for n in html5] + [f"&{n.rstrip(';')}" for n in html5] + [f"&{n};x&{n[:-1]}" for n in html5]
    assert len(html5) == 2231
    check(spark, texts)


def test_numbers(spark):
    codes = [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x1F600, 0x10FFFD, 0x10FFFF, 0x110000, 10**9, 10**30]
    check(spark, [f"&#{c};" for c in codes] + [f"x&#x{c:x}y" for c in codes] + [f"&#X{c:X};" for c in codes] + [f"&#000{c}" for c in codes])


def test_anything(spark):
    rnd = random.Random(1)
    pieces = ["&", "#", "x", ";", "amp", "lt", "notit", "notin;", "copy", "AMP", "&amp;lt;", " ", "<", "\n", "é", "65", "&#", "&#x", "zz" * 20, "\U0001f600"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(12))) for _ in range(800)] + ["", "&", "&;", "no entity", "&amp;" * 3000]
    assert check(spark, [*texts, None])[len(texts)] is None


def test_no_python_in_the_plan(spark, capsys):
    spark.createDataFrame([("&amp;",)], "t string").select(unescape_html(F.col("t"))).explain()
    assert "Python" not in capsys.readouterr().out
