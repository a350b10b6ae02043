"""Translate Python-style patterns to the Java syntax Spark evaluates.

Python text patterns know Unicode letters, digits and spaces; Java's ``\\w``,
``\\s`` and ``\\d`` are ASCII. The classes are spelled out so that a pattern
accepts the same text in Spark as in Python.
"""

from __future__ import annotations

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
DIGIT = r"\p{Nd}"

# every character Python's str.strip() removes
WHITESPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# letters that equal an ASCII letter when case is ignored
CASE_VARIANTS = "[\\u017f\\u0130\\u0131\\u212a]"


def expand(pattern: str, boundary: str) -> str:
    """Spell out character classes; ``boundary`` stands for ``\\b``."""
    out: list[str] = []
    in_class = False
    i = 0
    text = pattern.replace("(?P<match>", "(")
    while i < len(text):
        ch = text[i]
        if ch == "\\":
            esc = text[i + 1]
            i += 2
            if esc == "w":
                out.append(WORD if in_class else f"[{WORD}]")
            elif esc == "s":
                out.append(SPACE if in_class else f"[{SPACE}]")
            elif esc == "S" and not in_class:
                out.append(f"[^{SPACE}]")
            elif esc == "d":
                out.append(DIGIT)
            elif esc == "b" and not in_class:
                out.append(boundary)
            else:
                out.append("\\" + esc)
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            i += 1
            if text[i] == "^":
                out.append("^")
                i += 1
            continue
        if ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def java(pattern: str, ignore_case: bool = False, run: str = "", first: str = "") -> str:
    """Java form of ``pattern``; only ``\\n`` ends a line, as in Python.

    ``run`` names the class a pattern starts to repeat without limit. Within such a
    run no later start can match where the first one fails, so only the start of a
    run and the end of the previous match are tried: a blob of two million letters
    is then read once, not once per letter. ``first`` names the start of a pattern
    that can match only from its first start in the text; only that one is tried.
    """
    edge = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
    guard = f"(?:\\G|(?<!{run}))" if run else f"^(?>.*?(?={first}))" if first else ""
    return ("(?diu)" if ignore_case else "(?d)") + guard + expand(pattern, edge)
