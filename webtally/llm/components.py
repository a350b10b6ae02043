"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discarded, written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it is connected with, for every node in ``links`` (``a``, ``b``).

    Each round takes the smallest label of the neighbours, then the label of that label, so that distances halve. A round
    is one written table that also says what each label was; the driver sees whether one has changed.
    """
    ways = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
    edges = written(links.select(F.inline(ways)).distinct(), "edges")
    labels = edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"))
    labels = written(labels, "labels")
    while True:
        other = labels.select(F.col("node").alias("other"), F.col("label").alias("seen"))
        near = edges.join(other, "other").groupBy("node").agg(F.min("seen").alias("seen"))
        nearest = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = nearest.join(jump, "label", "left").select("node", "was", F.least("label", "further").alias("label"))
        moved = written(moved, "labels")
        discarded(labels)
        labels = moved.select("node", "label")
        labels.written_path = moved.written_path
        if moved.filter("label <> was").isEmpty():
            discarded(edges)
            return labels
