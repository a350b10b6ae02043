"""Library dependencies and their known vulnerabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import code
from ..catalog.vulns import KNOWN_VULNS, KnownVuln
from ..functions.dialect import SPACE
from ..functions.patterns import LinePattern, active_patterns, pattern_matches
from ..functions.text import constant, cut, explode_structs, first_by_key, let, reshape, split_lines, strip
from ..functions.versions import version_key
from ..limits import NONE, Limits

SECTIONS = ["dependencies", "devDependencies", "peerDependencies"]

_WHOLE_TEXT: list[LinePattern] = [
    LinePattern(code.DEPENDENCY_CDN[0], (1, 2), (("cdnjs.cloudflare.com",),)),
    LinePattern(code.DEPENDENCY_CDN[1], (1, 2), (("unpkg.com/",),)),
    LinePattern(code.DEPENDENCY_CDN[2], (1, 2), (("jsdelivr.net/",),)),
    LinePattern(code.DEPENDENCY_CDN[3], (1, 2), (("googleapis.com/",),)),
    LinePattern(code.DEPENDENCY_SCRIPT_NAME, (1, 2), ((".js", ".JS", ".Js", ".jS", ".jſ", ".Jſ"),), ignore_case=True),
]
_BANNERS: list[LinePattern] = [LinePattern(p, (1, 2)) for p in code.DEPENDENCY_BANNER]
_IMPORTS: list[LinePattern] = [LinePattern(code.DEPENDENCY_IMPORT, (1,), (("from", "require"),))]


def banner_lines(text: Column) -> Column:
    """``text`` in which lines that no banner can touch are ``#``, a character of no banner.

    A banner ends in a version, and only spaces lie between its name and that. So the lines that count have digits around
    a point, are blank, or stand before such a line. The slow banner patterns then read little of a bundle.
    """
    counts = rf"\p{{Nd}}\.\p{{Nd}}|^[{SPACE}]*$"
    flagged = F.transform(split_lines(text), lambda x: F.struct(x.alias("line"), x.rlike(counts).alias("counts")))

    def kept(lines: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            after = F.get(lines, i + 1).getField("counts")
            return F.when(x.getField("counts") | F.coalesce(after, F.lit(False)), x.getField("line")).otherwise("#")

        return F.transform(lines, of)

    return F.array_join(let(flagged, kept), "\n")


def manifest_entries(content: Column) -> Column:
    """``array<struct<section, name, spec>>`` of a package manifest, in its order."""
    fields = ", ".join(f"{s}: MAP<STRING, STRING>" for s in SECTIONS)
    # as the only element of an array, text after the object makes the value malformed
    wrapped = F.from_json(F.concat(F.lit("["), content, F.lit("]")), f"ARRAY<STRUCT<{fields}>>")

    def entries(manifest: Column) -> Column:
        def of_section(name: str) -> Column:
            return F.transform(
                F.coalesce(F.map_entries(manifest.getField(name)), F.array()),
                lambda e: F.struct(
                    F.lit(name).alias("section"), e.getField("key").alias("name"), e.getField("value").alias("spec")
                ),
            )

        return F.concat(*[of_section(s) for s in SECTIONS])

    return let(F.when(F.size(wrapped) == 1, F.get(wrapped, F.lit(0))), entries)


def load_manifests(files: DataFrame) -> DataFrame:
    """One row per entry of the three dependency sections of JSON files."""
    found = files.select("asset_id", manifest_entries(F.col("content")).alias("_entries"))
    return explode_structs(found, "_entries", "asset_id").where(F.col("name").isNotNull())


def clean_spec(spec: Column) -> Column:
    """Drop leading range operators and everything after the first space."""
    return F.split(F.regexp_replace(spec, r"^[\^~>=<]+", ""), " ", -1)[0]


def match_vuln(name: Column, version: Column, known: Sequence[KnownVuln] = KNOWN_VULNS) -> Column:
    """Id of the first known vulnerability that applies, NULL if none does.

    The table is a constant array, so no join is needed; the aliases of a name are
    tried in order, and within one library its entries in order.
    """
    table = F.transform(
        constant([v._asdict() for v in known], "array<struct<lib: string, below: string, cve: string>>"),
        lambda v: F.struct(
            v.getField("lib").alias("lib"), version_key(v.getField("below")).alias("below"), v.getField("cve").alias("cve")
        ),
    )
    norm = F.lower(strip(name))
    aliases = F.array(norm, F.replace(norm, F.lit(".js"), F.lit("")), F.replace(norm, F.lit("js"), F.lit("")))

    def search(args: Column) -> Column:
        def of_alias(alias: Column) -> Column:
            return F.filter(
                args.getField("table"),
                lambda v: (v.getField("lib") == alias)
                & F.coalesce(args.getField("key") < v.getField("below"), F.lit(False)),
            )

        return F.get(F.flatten(F.transform(args.getField("aliases"), of_alias)), F.lit(0)).getField("cve")

    return let(F.struct(aliases.alias("aliases"), version_key(version).alias("key"), table.alias("table")), search)


def _package_name(module: Column) -> Column:
    parts = F.split(module, "/", -1)
    return F.when(
        module.startswith("@") & (F.size(parts) >= 2), F.concat_ws("/", parts[0], F.get(parts, F.lit(1)))
    ).otherwise(parts[0])


def dependency_array(
    content: Column, file_type: Column, known: Sequence[KnownVuln] = KNOWN_VULNS, limits: Limits = NONE
) -> Column:
    """``array<struct<ord, name, version, source, vulnerable, cve>>`` of one file.

    ``ord`` is the order of discovery: manifest, script URLs, banners, imports.
    """

    def entry(src: int, label: str, a: Column, b: Column, name: Column, version: Column) -> Column:
        return F.struct(
            F.lower(name).alias("key"), version.alias("version"),
            F.struct(F.lit(src).alias("src"), a.cast("int").alias("a"), b.cast("int").alias("b")).alias("ord"),
            name.alias("name"), F.lit(label).alias("source"),
        )

    manifest = F.when(
        file_type == "json",
        F.transform(
            manifest_entries(content),
            lambda e, i: entry(1, "package.json", F.lit(0), i, e.getField("name"), clean_spec(e.getField("spec"))),
        ),
    )

    def matches(text: Column, patterns: list[LinePattern], src: int, label: str) -> Column:
        found = let(
            active_patterns(patterns, text),
            lambda active: pattern_matches(active, F.array(text), len(patterns[0].groups)),
        )
        if src == 4:
            return F.transform(
                found, lambda m: entry(4, label, m.getField("id"), m.getField("pos"), _package_name(m.getField("g1")), F.lit("unknown"))
            )
        return F.transform(
            found, lambda m: entry(src, label, m.getField("id"), m.getField("pos"), m.getField("g1"), m.getField("g2"))
        )

    top = banner_lines(cut(content, limits.banner))
    everything = F.concat(
        F.coalesce(manifest, F.array()),
        matches(content, _WHOLE_TEXT, 2, "cdn"),
        F.filter(matches(top, _BANNERS, 3, "inline_banner"), lambda d: d.getField("name") != "unknown"),
        F.filter(matches(content, _IMPORTS, 4, "import"), lambda d: d.getField("name") != ""),
    )
    present = F.filter(everything, lambda d: d.getField("name").isNotNull() & d.getField("version").isNotNull())
    firsts = first_by_key(present, ["key", "version"])

    def judge(d: Column) -> Column:
        cve = F.when(d.getField("source") != "import", match_vuln(d.getField("name"), d.getField("version"), known))
        return let(
            cve,
            lambda c: F.struct(
                d.getField("ord").alias("ord"), d.getField("name").alias("name"), d.getField("version").alias("version"),
                d.getField("source").alias("source"), c.isNotNull().alias("vulnerable"),
                F.coalesce(c, F.lit("")).alias("cve"),
            ),
        )

    return F.transform(F.sort_array(reshape(firsts, "ord", "name", "version", "source")), judge)


def with_dependencies(
    assets: DataFrame, known: Sequence[KnownVuln] = KNOWN_VULNS, limits: Limits = NONE
) -> DataFrame:
    return assets.withColumn("_dependencies", dependency_array(F.col("content"), F.col("file_type"), known, limits))


def dependencies(
    assets: DataFrame, known: Sequence[KnownVuln] = KNOWN_VULNS, limits: Limits = NONE
) -> DataFrame:
    """One row per file and dependency; the first of each (lower name, version) wins."""
    found = with_dependencies(assets.select("asset_id", "url", "file_type", "content"), known, limits)
    return explode_structs(found.withColumnRenamed("url", "source_url"), "_dependencies", "asset_id", "source_url")


def match_vulns(deps: DataFrame, known: Sequence[KnownVuln] = KNOWN_VULNS) -> DataFrame:
    """Add ``vulnerable`` and ``cve`` to rows with ``name`` and ``version``."""
    return deps.withColumn("cve", match_vuln(F.col("name"), F.col("version"), known)).select(
        *[c for c in deps.columns if c not in ("cve", "vulnerable")],
        F.col("cve").isNotNull().alias("vulnerable"),
        F.coalesce("cve", F.lit("")).alias("cve"),
    )


def corpus_dependencies(deps: DataFrame) -> DataFrame:
    """First of each (lower name, version) over all files, in file and discovery order.

    ``min_by`` aggregates partially before the shuffle, so a library that every
    file uses costs one row per task.
    """
    order = F.struct("asset_id", "ord")
    pick = F.struct("name", "version", "source", "vulnerable", "cve")
    return (
        deps.groupBy(F.lower("name").alias("_key"), F.col("version").alias("_version"))
        .agg(F.min_by(pick, order).alias("d"))
        .select("d.*")
    )
