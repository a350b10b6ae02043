"""Decode the usual ways of hiding text in script and markup."""

from __future__ import annotations

import zlib
from html.entities import html5

from pyspark.sql import Column, functions as F

from .text import constant, let, strings

# a high and a low surrogate escape, or one escape outside the surrogate range
_UNICODE_UNIT = (
    r"(?:\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    r"|\\u(?![dD][89a-fA-F])[0-9a-fA-F]{4})"
)
_HEX = r"\\x([0-9a-fA-F]{2})"
_UNICODE_RUN = f"({_UNICODE_UNIT}++)"  # possessive: a long run must not recurse
_UNICODE_BRACED = r"(\\u\{[0-9a-fA-F]{1,6}\})"
_BASE64_CALL = r"""(atob\s*\(\s*["'][A-Za-z0-9+/=]{8,}["']\s*\))"""
_BASE64_ARG = r"""["']([A-Za-z0-9+/=]{8,})["']"""
_LITERAL_PAIR = r"""((["'])([^"']*?)\2\s*\+\s*(["'])([^"']*?)\4)"""
_PRINTABLE = r"^[\x20-\x7e\n\r\t]*$"


def replace_matches(text: Column, pattern: str, matches: Column, replacement) -> Column:
    """Replace every match by ``replacement(match)``: split, rewrite, join."""
    pieces = F.split(text, pattern, -1)
    return F.array_join(
        F.zip_with(pieces, matches, lambda piece, m: F.concat(piece, F.coalesce(replacement(m), F.lit("")))), ""
    )


def decode_hex(text: Column) -> Column:
    r"""``\x41`` → ``A``."""
    codes = F.regexp_extract_all(text, F.lit(_HEX), F.lit(1))
    decoded = replace_matches(text, _HEX, codes, lambda c: F.decode(F.unhex(c), "ISO-8859-1"))
    return F.when(F.contains(text, F.lit("\\x")), decoded).otherwise(text)


def decode_unicode(text: Column) -> Column:
    r"""Four-digit and braced escapes; surrogate escapes decode as pairs, lone ones stay."""
    runs = F.regexp_extract_all(text, F.lit(_UNICODE_RUN), F.lit(1))
    plain = replace_matches(
        text, _UNICODE_RUN, runs,
        lambda r: F.decode(F.unhex(F.regexp_replace(r, r"\\u", "")), "UTF-16BE"),
    )
    plain = F.when(F.contains(text, F.lit("\\u")), plain).otherwise(text)

    def one(m: Column) -> Column:
        code = F.regexp_replace(m, r"[\\u{}]", "")
        value = F.conv(code, 16, 10).cast("int")
        valid = (value <= 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
        return F.when(m.isNull(), F.lit(None).cast("string")).when(
            valid, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        ).otherwise(m)

    braced = replace_matches(
        plain, _UNICODE_BRACED, F.regexp_extract_all(plain, F.lit(_UNICODE_BRACED), F.lit(1)), one
    )
    return F.when(F.contains(plain, F.lit("\\u{")), braced).otherwise(plain)


def decode_base64_literals(text: Column) -> Column:
    """``atob("…")`` → readable literal behind a marker comment; unreadable ones stay."""

    def one(m: Column) -> Column:
        raw = F.try_to_binary(F.regexp_extract(m, _BASE64_ARG, 1), F.lit("base64"))
        shown = F.decode(raw, "ISO-8859-1")
        return F.when(
            shown.rlike(_PRINTABLE), F.concat(F.lit('/* b64decoded: */ "'), shown, F.lit('"'))
        ).otherwise(m)

    calls = F.regexp_extract_all(text, F.lit(_BASE64_CALL), F.lit(1))
    return F.when(
        F.contains(text, F.lit("atob")), replace_matches(text, _BASE64_CALL, calls, one)
    ).otherwise(text)


def _join_once(text: Column) -> Column:
    pairs = F.regexp_extract_all(text, F.lit(_LITERAL_PAIR), F.lit(1))

    def one(m: Column) -> Column:
        def part(k: int) -> Column:
            return F.regexp_extract(m, _LITERAL_PAIR, k)

        return F.when(part(2) == part(4), F.concat(part(2), part(3), part(5), part(2))).otherwise(m)

    return replace_matches(text, _LITERAL_PAIR, pairs, one)


def join_string_literals(text: Column) -> Column:
    """``"a" + "b"`` → ``"ab"`` until nothing changes.

    Every useful round removes at least one literal pair, so the number of pairs
    bounds the rounds. A round hands on the text even where nothing is left to do,
    so rounds are grouped by the root of their number and idle groups are passed over.
    """
    pluses = F.regexp_count(text, F.lit(r"""["']\s*\+\s*["']"""))
    start = F.struct(text.alias("text"), F.lit(False).alias("done"))

    def unless_done(acc: Column, more: Column) -> Column:
        return F.when(acc.getField("done"), acc).otherwise(more)

    def step(acc: Column, _: Column) -> Column:
        before = acc.getField("text")
        joined = let(_join_once(before), lambda after: F.struct(after.alias("text"), (after == before).alias("done")))
        return unless_done(acc, joined)

    def rounds(root: Column) -> Column:
        turns = F.sequence(F.lit(1), root)
        return F.aggregate(turns, start, lambda acc, _: unless_done(acc, F.aggregate(turns, acc, step))).getField("text")

    joined = let(F.ceil(F.sqrt(pluses)).cast("int"), rounds)
    return F.when(pluses > 0, joined).otherwise(text)


# -- entities ------------------------------------------------------------------

# What a reference looks like.
_REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Buckets of the table of names, so that a lookup compares a few of them.
_BUCKETS = 512
_REPLACEMENT = "�"
#: Before a name, and between a name and its text. Neither is in a name or its text.
_BEFORE, _BETWEEN = "\x02", "\x01"


def _name_table() -> list[str]:
    """The standard's names (with their semicolon, some also without) and their texts, by the CRC-32 of the name.

    A bucket is one string: plans compare their constants again and again, and strings are compared fastest.
    """
    out = [""] * _BUCKETS
    for name, text in html5.items():
        out[zlib.crc32(name.encode()) % _BUCKETS] += f"{_BEFORE}{name}{_BETWEEN}{text}"
    return out


#: Lengths of the names that need no semicolon: these may also begin a longer word. Longest first.
_OPEN_LENGTHS = sorted({len(n) for n in html5 if not n.endswith(";")}, reverse=True)


def _windows_text(code: int) -> str:
    """What a reference to a C1 control stands for: the character that byte has in Windows-1252, if it has one."""
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _numeric_reference(reference: Column) -> Column:
    """``#65;`` or ``#x41`` as text."""
    hexadecimal = F.lower(F.substring(reference, 2, 1)) == "x"
    digits = F.regexp_replace(reference, "^#[xX]?0*|;$", "")
    short = F.when(F.length(digits) <= 8, F.when(digits == "", "0").otherwise(digits))
    code = F.when(hexadecimal, F.conv(short, 16, 10)).otherwise(short).cast("bigint")
    controls = constant([_windows_text(c) for c in range(0x80, 0xA0)], "array<string>")

    def text(c: Column) -> Column:
        nothing = (
            c.between(0x1, 0x8) | (c == 0xB) | c.between(0xE, 0x1F) | (c == 0x7F) | c.between(0xFDD0, 0xFDEF) | (c.bitwiseAND(0xFFFE) == 0xFFFE)
        )
        plain = F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
        return (
            F.when(c.isNull() | (c == 0) | c.between(0xD800, 0xDFFF) | (c > 0x10FFFF), _REPLACEMENT)
            .when(c.between(0x80, 0x9F), F.get(controls, (c - 0x80).cast("int"))).when(nothing, "").otherwise(plain)
        )

    return let(code, text)


def _named_reference(reference: Column, table: Column) -> Column:
    """A name with its semicolon, or the longest name that needs none and begins the reference; else as it is."""

    def known(name: Column) -> Column:
        bucket = F.get(table, F.pmod(F.crc32(F.encode(name, "UTF-8")), F.lit(_BUCKETS)).cast("int"))
        entry = F.concat(F.lit(_BEFORE), name, F.lit(_BETWEEN))
        found = F.split_part(F.split_part(bucket, entry, F.lit(2)), F.lit(_BEFORE), F.lit(1))
        return F.when((found != "") & ~F.contains(name, F.lit(_BETWEEN)), found)

    parts = [F.when(F.length(reference) > n, F.concat(known(F.left(reference, F.lit(n))), F.substring(reference, n + 1, 33))) for n in _OPEN_LENGTHS]
    return F.coalesce(known(reference), *parts, F.concat(F.lit("&"), reference))


def unescape_html(text: Column) -> Column:
    """Decode HTML entities by the rules of the HTML standard; a text is cut at its references."""
    references = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1))
    table = strings(_name_table())

    def one(reference: Column) -> Column:
        numeric = F.when(reference.startswith("#"), _numeric_reference(reference))
        return F.when(reference.isNotNull(), F.coalesce(numeric, _named_reference(reference, table)))

    return F.when(F.contains(text, F.lit("&")), replace_matches(text, _REFERENCE, references, one)).otherwise(text)
