"""Personal data replaced by surrogates (operator 3, DataFrame functions only).

One pattern finds the entities. The same entity has the same normal form however it is written, and the normal form and
a key decide its surrogate: of the same kind, with digits for digits and letters for letters of the same case and script,
a valid check digit where the card had one. A mention then gets the surrogate in its own format.

A person is found by a title. Each part of the name is an entity of its own: the last one a family name, those before it given
names of the gender the title states. So "Mr. John Smith", "Mr. Smith" and "Mrs. Anna Smith" agree in what they share, and one
given name under both genders has two surrogates. Where a document has a titled name, the parts of it are replaced
in that document without a title too. A single name after a title counts as a family name.

All distinct entities of the corpus are checked together: of entities with one surrogate the first keeps it, and a
surrogate that is itself an entity is given up; the others draw again until none is left. After a few rounds surrogates
grow by a drawn character a round, so that the forms of a shape never run out. So distinct entities stay distinct and every
mention of one entity, in any document, gets one surrogate.

Null texts stay null, empty ones empty, texts without entities are unchanged. Rows that repeat in id and text get equal
results. An empty table gives an empty result. Work per row is linear in its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import constant, let
from .common import NO_ID, written

#: What is looked for, by kind (fixed values). All begin where no letter or digit stands before; secrets and persons are
#: found with the word that tells of them. Quantifiers of open length are possessive, so that no pattern backs up.
EMAIL = r"(?<![._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+"
AWS_KEY = r"A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])"
SECRET_WORD = r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|passwd|pwd|[Kk]ey|KEY|api_key|API_KEY)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
SECRET = SECRET_WORD + r"[A-Za-z0-9_\-+/=.]{8,}+"
IPV4 = r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"
PHONE = r"(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .\-]\d{2,4}){2,4}(?!\d)|(?<![\-+])\d{3}([.\-])\d{3}\1\d{4}(?![\d\-])"
SSN = r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d\-])"
CARD = r"(?<!\.)(?:\d{13,19}|\d{4}([ \-])\d{4}\2\d{4}\2\d{4})(?!\d)"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
MALE = r"Mr|Herr|Señor|Sr|Monsieur|Господин"
FEMALE = r"Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Госпожа"
TITLE = rf"(?:{FEMALE}|{MALE})\.? "
#: A part of a name: hyphens, apostrophes and capitals inside it belong to it.
NAME = r"\p{Lu}\p{L}*+(?:['’\-]\p{L}++)*+"
PERSON = rf"{TITLE}{NAME}(?: {NAME})*+"
KINDS = (EMAIL, AWS_KEY, PHONE, SSN, IPV4, CARD, IBAN, SECRET, PERSON)
ENTITY = "(?<![A-Za-z0-9])(?:" + "|".join(KINDS) + ")"
#: In documents with a titled name: every part of a name as well.
WITH_NAMES = "(?<![A-Za-z0-9])(?:" + "|".join((*KINDS, rf"(?<![\p{{L}}\p{{N}}'’\-]){NAME}")) + ")"

#: Given names by gender, and syllables of family names (fixed values).
GIVEN = {
    "latin_m": "Adam Anton Carlos Daniel David Emil Felix Georg Hugo Ivan Jakob Jonas Karl Leon Lucas Marco Martin Oscar Paul Peter Rafael Simon Thomas Victor".split(),
    "latin_f": "Alma Anna Carla Clara Daria Elena Emma Eva Flora Greta Helena Ida Irene Julia Laura Lea Lucia Maria Marta Nina Olga Paula Rosa Sofia".split(),
    "cyrillic_m": "Антон Борис Виктор Денис Егор Иван Кирилл Максим Олег Павел Роман Сергей".split(),
    "cyrillic_f": "Алина Анна Вера Дарья Елена Инна Ксения Лидия Мария Нина Ольга Софья".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ha ja ka ke la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo wa we za".split(),
    "cyrillic": "ба бе бо ва во га да де до за ка ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то фа ха ша".split(),
}
ALPHABETS = {
    "[0-9]": "0123456789", "[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "[а-яё]": "абвгдежзиклмнопрстуфхцчшэюя", "[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    "[α-ω]": "αβγδεζηθικλμνξοπρστυφχψω", "[Α-Ω]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
}
BY_DIGITS = ("phone", "ssn", "card")
NAMES = ("family", "given_m", "given_f")
#: Rounds in which surrogates keep the length of what they replace.
SAME_LENGTH = 4


def _picked(alphabet: str, h: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(h, F.lit(len(alphabet))).cast("int") + 1, F.lit(1))


def kind_of(mention: Column) -> Column:
    """The kind of a match of ENTITY."""
    whole = lambda p: mention.rlike(f"^(?:{p})$")
    return (
        F.when(whole(EMAIL), "email").when(whole(AWS_KEY), "aws_key").when(whole(IPV4), "ipv4").when(whole(SSN), "ssn")
        .when(whole(r"\+?[\d(][\d() .\-]*") & ~whole(r"\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}"), "phone")
        .when(whole(r"\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}"), "card").when(whole(IBAN), "iban")
        .when(whole(PERSON), "person").when(whole(NAME), "name").otherwise("secret")
    )


def normal_form(kind: Column, mention: Column) -> Column:
    """What all mentions of one entity have in common."""
    digits = F.regexp_replace(mention, r"[^0-9+]", "")
    told = F.when(kind == "secret", F.regexp_replace(mention, f"^{SECRET_WORD}", ""))
    return told.when(kind.isin(*BY_DIGITS), digits).when(kind == "email", F.lower(mention)).when(kind == "iban", F.regexp_replace(mention, " ", "")).otherwise(mention)


def _luhn(digits: Column) -> Column:
    """The check sum of an array of digits, the last of which is the check digit."""
    doubled = F.transform(
        F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10


def _digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("int"))


def _drawn(chars: Column, seed: Column, first: Column, last: Column, hexadecimal: Column) -> Column:
    """Each character in [first, last) by one of its own class, drawn from the seed and its place."""

    def one(c: Column, i: Column) -> Column:
        h = F.xxhash64(seed, i)
        out = F.when((i < first) | (i >= last), c).when(hexadecimal & c.rlike("[a-f]"), _picked("abcdef", h))
        for pattern, alphabet in ALPHABETS.items():
            out = out.when(c.rlike(pattern), _picked(alphabet, h))
        return out.otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _named(seed: Column, kind: Column, normal: Column, attempt: Column) -> Column:
    """A given name of the kind's gender or a family name of four syllables, in the script of the original, small letters.

    After a few rounds given names are joined by hyphens, one more a round.
    """

    def family(script: str) -> Column:
        parts = constant(SYLLABLES[script], "array<string>")
        return F.concat(*[F.get(parts, F.pmod(F.xxhash64(seed, F.lit(100 + j)), F.lit(len(SYLLABLES[script]))).cast("int")) for j in range(4)])

    def given(script: str, gender: str) -> Column:
        names = GIVEN[f"{script}_{gender}"]
        pick = lambda i: F.get(constant([n.lower() for n in names], "array<string>"), F.pmod(F.xxhash64(seed, F.lit(300) + i), F.lit(len(names))).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(attempt - SAME_LENGTH + 1, F.lit(0))), pick), "-")

    of = lambda script: F.when(kind == "given_f", given(script, "f")).when(kind == "given_m", given(script, "m")).otherwise(family(script))
    return F.when(normal.rlike(r"[Ѐ-ӿ]"), of("cyrillic")).otherwise(of("latin"))


def surrogate(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a normal form; another one for each attempt."""

    def made(seed: Column) -> Column:
        chars = F.filter(F.split(normal, ""), lambda c: c != "")
        first = F.when(kind == "aws_key", 4).when(kind == "iban", 2).when((kind == "phone") & normal.startswith("+"), 2).when(kind == "card", 1).otherwise(0)
        last = F.when(kind == "email", F.length(normal) - F.length(F.substring_index(normal, ".", -1))).otherwise(F.length(normal))
        plain = _drawn(chars, seed, first, last, (kind == "secret") & normal.rlike("^[0-9a-f]+$"))
        # a value of signs alone, such as a line to fill in, has nothing of these classes: each sign by a letter
        signs = F.array_join(F.transform(chars, lambda c, i: _picked(ALPHABETS["[a-z]"], F.xxhash64(seed, i))), "")
        plain = F.when((kind == "secret") & ~normal.rlike("[A-Za-z0-9]"), signs).otherwise(plain)
        extra = lambda alphabet: F.when(attempt >= SAME_LENGTH, F.array_join(F.transform(
            F.sequence(F.lit(1), F.greatest(attempt - SAME_LENGTH + 1, F.lit(1))), lambda i: _picked(alphabet, F.xxhash64(seed, F.lit(200) + i))), "")).otherwise("")
        digits, letters = extra("0123456789"), extra(ALPHABETS["[a-z]"])
        plain = F.when(kind == "email", F.concat(letters, plain)).when(kind.isin(*BY_DIGITS, "iban", "aws_key") | normal.rlike("^[0-9a-f]+$"), F.concat(plain, digits)).otherwise(F.concat(plain, letters))
        name = _named(seed, kind, normal, attempt)
        name = F.when(kind != "family", name).when(normal.rlike(r"[Ѐ-ӿ]"), F.concat(name, extra(ALPHABETS["[а-яё]"]))).otherwise(F.concat(name, letters))
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(F.xxhash64(seed, i), F.lit(254)) + 1).cast("string")), ".")
        card = let(plain, lambda s: let(F.left(s, F.length(s) - 1), lambda body: F.when(
            _luhn(_digits(normal)) == 0, F.concat(body, ((10 - _luhn(_digits(F.concat(body, F.lit("0"))))) % 10).cast("string"))
        ).otherwise(s)))
        return F.when(kind == "ipv4", octets).when(kind.isin(*NAMES), name).when(kind == "card", card).otherwise(plain)

    return let(F.xxhash64(F.lit(key), kind, normal, attempt), lambda seed: made(seed))


def rendered(kind: Column, mention: Column, normal: Column, replacement: Column) -> Column:
    """A surrogate in the format of one mention: its separators, its upper case."""
    chars = F.filter(F.split(mention, ""), lambda c: c != "")
    by_case = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(replacement, i + 1, F.lit(1)))).otherwise(F.substring(replacement, i + 1, F.lit(1)))), "")

    def filled(symbols: str) -> Column:
        # these mentions are short: the place of a symbol is counted from the start
        place = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), f"[^{symbols}]", ""))
        return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(f"[{symbols}]"), F.substring(replacement, place(i), F.lit(1))).otherwise(c)), "")

    # what a surrogate has beyond the length of its entity follows
    name = F.array_join(F.transform(F.split(replacement, "-"), F.initcap), "-")
    name = F.when((F.length(mention) > 1) & (mention == F.upper(mention)), F.upper(replacement)).otherwise(name)
    more = F.substring(replacement, F.length(normal) + 1, F.greatest(F.length(replacement) - F.length(normal), F.lit(0)))
    return F.when(kind.isin(*NAMES), name).when(kind == "email", F.concat(by_case, more)).when(kind.isin(*BY_DIGITS), F.concat(filled("0-9+"), more)).when(kind == "iban", F.concat(filled("A-Z0-9"), more)).otherwise(
        F.concat(F.left(mention, F.length(mention) - F.length(normal)), replacement)  # what told of it stays
    )


def _assigned(entities: DataFrame, key: str) -> DataFrame:
    """kind, normal and a replacement for each distinct entity; no two entities share one, none is an entity."""
    draw = lambda df: df.withColumn("replacement", surrogate(F.col("kind"), F.col("normal"), F.col("attempt"), key))
    current = written(draw(entities.withColumn("attempt", F.lit(0))), "entities")
    taken = entities.select("kind", F.col("normal").alias("replacement"), F.lit(True).alias("real"))
    while True:
        # one replacement is drawn by a few entities at most, so no window is large
        first = Window.partitionBy("kind", "replacement").orderBy("attempt", "normal")
        judged = current.withColumn("place", F.row_number().over(first)).join(taken, ["kind", "replacement"], "left")
        judged = written(judged.withColumn("again", (F.col("place") > 1) | F.col("real").isNotNull()).drop("place", "real"), "entities")
        if judged.filter("again").isEmpty():
            return judged.select("kind", "normal", "replacement")
        stays = judged.filter("not again").drop("again")
        redrawn = draw(judged.filter("again").select("kind", "normal", (F.col("attempt") + 1).alias("attempt")))
        current = written(stays.select("kind", "normal", "attempt", "replacement").unionByName(redrawn), "entities")


def _titled(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"(?<![A-Za-z0-9]){TITLE}\p{{Lu}}"), F.lit(False))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Row key, place, kind and mention of everything that matches; of kind ``name`` only some are entities."""
    keyed = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("k_id"), F.xxhash64(F.col(text_col).cast("string")).alias("k_text"), F.col(text_col).cast("string").alias("text"))
    every = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    matches = keyed.withColumn("m", F.when(_titled(F.col("text")), every(WITH_NAMES)).otherwise(every(ENTITY)))
    some = matches.filter(F.size("m") > 0)
    # rows that repeat in id and text are one here
    each = some.dropDuplicates(["k_id", "k_text"]).select("k_id", "k_text", F.posexplode("m").alias("place", "mention"))
    return each.withColumn("kind", kind_of(F.col("mention")))


def _parts(kind: Column, mention: Column) -> Column:
    """The entities of a mention as (kind, piece of the mention, normal form): of a person the parts of the name, else one."""
    given = F.when(mention.rlike(rf"^(?:{FEMALE})\b"), "given_f").otherwise("given_m")
    names = F.split(F.regexp_replace(mention, f"^{TITLE}", ""), " ")
    of = lambda k, piece, normal: F.struct(k.alias("kind"), piece.alias("piece"), normal.alias("normal"))
    name = let(names, lambda n: F.transform(n, lambda x, i: of(F.when(i == F.size(n) - 1, "family").otherwise(given), x, F.lower(x))))
    return F.when(kind == "person", name).otherwise(F.array(of(kind, mention, normal_form(kind, mention))))


def _entities(found: DataFrame) -> DataFrame:
    """The rows of ``found`` with ``parts``; a name without a title has the entity it is part of in its document, or none."""
    titled = found.filter("kind <> 'name'").withColumn("parts", _parts(F.col("kind"), F.col("mention")))
    known = titled.filter("kind = 'person'").select("k_id", "k_text", F.inline("parts"))
    # of several a name is a family name first
    known = known.groupBy("k_id", "k_text", "normal").agg(F.min("kind").alias("is")).withColumnRenamed("normal", "name")
    loose = found.filter("kind = 'name'").withColumn("name", F.lower("mention")).join(known, ["k_id", "k_text", "name"], "left")
    one = F.array(F.struct(F.col("is").alias("kind"), F.col("mention").alias("piece"), F.col("name").alias("normal")))
    loose = loose.withColumns({"parts": F.when(F.col("is").isNotNull(), one), "kind": F.when(F.col("is").isNotNull(), "person").otherwise("name")})
    return titled.unionByName(loose.select(titled.columns))


def with_surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", kinds_col: str = "entities") -> DataFrame:
    """The rows with all their columns, their text with surrogates, and ``kinds_col``, an array of the kinds found.

    A column of ``docs`` that has this name is replaced; give another name to keep it.
    """
    found = written(_entities(written(_found(docs, id_col, text_col), "mentions")), "entities")
    forms = found.filter("parts IS NOT NULL").select("mention", "parts").distinct()
    each = written(forms.select("mention", "parts", F.posexplode("parts").alias("i", "part")).select("mention", "parts", "i", "part.*"), "parts")
    assigned = _assigned(written(each.select("kind", "normal").distinct(), "entities"), key)
    each = each.join(assigned, ["kind", "normal"])
    piece = rendered(F.col("kind"), F.col("piece"), F.col("normal"), F.col("replacement"))
    form = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", piece.alias("form")))), lambda x: x["form"]), " ")
    title = F.regexp_extract("mention", f"^{TITLE}", 0)
    forms = each.groupBy("mention", "parts").agg(form.alias("name")).select("mention", "parts", F.concat(title, "name").alias("form"))
    shown = found.join(forms, ["mention", "parts"], "left").withColumn("form", F.coalesce("form", "mention"))
    lists = shown.groupBy("k_id", "k_text").agg(F.sort_array(F.collect_list(F.struct("place", "form", "kind"))).alias("forms"))
    lists = lists.select(F.col("k_id").alias("id"), F.col("k_text").alias("hash"), "forms")
    # all columns of the rows travel as one, so that none can have the name of another one here
    text = F.col(f"row.{text_col}").cast("string")
    held = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    pieces = F.when(_titled(text), F.split(text, WITH_NAMES, -1)).otherwise(F.split(text, ENTITY, -1))
    replaced = F.array_join(F.zip_with(pieces, F.col("forms.form"), lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))), "")
    changed = F.when(F.col("forms").isNull(), text).otherwise(replaced)
    kinds = F.coalesce(F.filter("forms.kind", lambda k: k != "name"), F.array().cast("array<string>"))
    kept = [changed.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != kinds_col]
    return held.join(lists, ["id", "hash"], "left").select(*kept, kinds.alias(kinds_col))
