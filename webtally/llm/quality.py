"""Quality rules kept as a ledger of failure bits (operator 6, DataFrame functions only).

Every rule is evaluated once for every row. Its outcome is one bit of ``failed``, next to the measurements it was taken
from. Policies are masks over these bits: a new policy version, or what would change without one of its rules, is bit
arithmetic over the ledger and never reads text again.

A null text has no words, an empty one neither; both fail ``few_words``. Rows are independent, so repeated rows and ties
get equal results; an empty table gives an empty ledger; other columns are ignored. Work per row is n log n in its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from .common import document_rows

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+", -1), "")


def window_keys(words: Column, size: int = WINDOW) -> Column:
    """A 64-bit hash of each window of consecutive words."""
    hashed = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)])
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), hashed)).otherwise(
        F.array().cast("array<bigint>")
    )


def repeated_words(keys: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more, the first one included."""

    def covered(ordered: Column) -> Column:
        same = lambda e, i: F.coalesce(F.get(ordered, i)["key"] == e["key"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(ordered, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["at"]))
        parts = let(at, lambda a: F.transform(a, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(a, i + 1) - x, F.lit(size)))))
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    placed = F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at")))
    # a text without a repeated window, the common case, is not sorted
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("bigint")).otherwise(let(F.sort_array(placed), covered))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measurements for each row."""
    rows = document_rows(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"words": words_of(F.col("text")), "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    count = lambda c: c.cast("bigint")
    return rows.select(
        "doc_id",
        count(F.size("words")).alias("n_words"),
        count(F.length(F.regexp_replace("text", SPACE + "+", ""))).alias("word_chars"),
        count(F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", ""))).alias("n_symbols"),
        count(F.size("lines")).alias("n_lines"),
        count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        let(F.col("words"), lambda w: let(window_keys(w), lambda k: repeated_words(k))).alias("n_repeat_words"),
    )


def rules() -> list[tuple[str, Column]]:
    """The rules by bit: when a row fails, from the measurements alone. A bit is never given a new meaning."""
    c = F.col
    return [
        ("few_words", c("n_words") < 10),
        ("repeated_words", 100 * c("n_repeat_words") > 20 * c("n_words")),
        ("short_words", c("word_chars") < 2 * c("n_words")),
        ("long_words", c("word_chars") > 20 * c("n_words")),
        ("symbols", 10 * c("n_symbols") > c("n_words")),
        ("duplicate_lines", 10 * c("n_dup_lines") > 3 * c("n_lines")),
    ]


NAMES = ["few_words", "repeated_words", "short_words", "long_words", "symbols", "duplicate_lines"]


def mask(*names: str) -> int:
    return sum(1 << NAMES.index(n) for n in names)


#: Rules by policy version. A version is never changed, only followed by another.
POLICIES = {
    "base": mask("few_words", "repeated_words"),
    "v1": mask("few_words", "repeated_words", "symbols", "duplicate_lines"),
    "v2": mask(*NAMES),
}


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failed``, one bit for each rule."""
    bits = F.lit(0).cast("bigint")
    for bit, (_, fails) in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
    return measured(docs, id_col, text_col).withColumn("failed", bits)


def rejected(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) != 0


def judged(rows: DataFrame, policy: str) -> DataFrame:
    """The verdict of one policy over a ledger."""
    return rows.withColumns({"base_failed": rejected("base"), "kept": ~rejected("base") & ~rejected(policy)})


def ablations(rows: DataFrame) -> DataFrame:
    """For each policy and each of its rules: rows it rejects, rows that fail the rule, rows only this rule rejects.

    One pass over the ledger, summed within each task before anything is shuffled.
    """
    counts = []
    for version, policy in POLICIES.items():
        bad = F.col("failed").bitwiseAND(F.lit(policy))
        for bit, name in enumerate(NAMES):
            if policy >> bit & 1:
                counts.append(
                    F.struct(
                        F.lit(version).alias("policy"), F.lit(name).alias("rule"), F.count_if(bad != 0).alias("rejected"),
                        F.count_if(F.getbit(bad, F.lit(bit)) == 1).alias("failed_rule"), F.count_if(bad == (1 << bit)).alias("only_this_rule"),
                    )
                )
    return rows.agg(F.array(*counts).alias("c")).select(F.inline("c"))
