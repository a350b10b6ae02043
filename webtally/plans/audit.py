"""The whole audit of a table of assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import explode_structs
from ..limits import NONE, Limits
from ..operators.briefing import briefings, with_extracts
from ..operators.normalization import normalize_content
from ..operators.signatures import explode_hits


def extract(assets: DataFrame, limits: Limits = NONE) -> DataFrame:
    """Normalised text and all extractions of every file, one row per file.

    This is the expensive pass over the text. On large data write it once and
    build the tables below from the written copy, which then reads only the arrays
    a table needs.
    """
    return with_extracts(normalize_content(assets), limits=limits)


def tables(extracts: DataFrame, limits: Limits = NONE) -> dict[str, DataFrame]:
    """The result tables of an audit over the rows of ``extract``."""
    return {
        "findings": explode_hits(extracts),
        "code_facts": explode_structs(extracts, "_facts", "asset_id"),
        "endpoints": explode_structs(
            extracts.withColumnRenamed("url", "source_url"), "_endpoints", "asset_id", "source_url"
        ).drop("ord", "pos"),
        "dependencies": explode_structs(
            extracts.withColumnRenamed("url", "source_url"), "_dependencies", "asset_id", "source_url"
        ),
        "sinks_sources": explode_structs(extracts, "_flows", "asset_id").drop("ord"),
        "briefings": briefings(extracts, limits=limits).select("asset_id", "url", "file_type", "briefing"),
        "files": extracts.select(
            "asset_id", "url", "file_type", F.length("content").alias("size"),
            F.size("_hits").cast("bigint").alias("sig_findings_count"),
        ),
    }


def audit(assets: DataFrame, limits: Limits = NONE) -> dict[str, DataFrame]:
    return tables(extract(assets, limits), limits)
