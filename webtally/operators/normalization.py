"""Content normalisation of asset tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..catalog.code import DECODABLE_TYPES, MARKUP_TYPES
from ..functions import normalize as N


def normalize_content(assets: DataFrame, col: str = "content") -> DataFrame:
    """Hex, Unicode, base64 and literal joins in order, then entities in markup.

    Other file types pass unchanged. Each pass is its own projection so that it
    sees the finished text of the pass before.
    """
    decodable = F.col("file_type").isin(DECODABLE_TYPES)
    out = assets
    for step in (N.decode_hex, N.decode_unicode, N.decode_base64_literals, N.join_string_literals):
        out = out.withColumn(col, F.when(decodable, step(F.col(col))).otherwise(F.col(col)))
    markup = F.when(F.col("file_type").isin(MARKUP_TYPES), F.col(col))
    out = out.withColumn(col, F.coalesce(N.unescape_html(markup), F.col(col)))
    if "size" in out.columns:
        out = out.withColumn("size", F.length(col))
    return out
