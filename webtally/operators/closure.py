"""Breadth-first link closure over stored pages."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import urls
from ..session import reliable_checkpoint
from .discovery import html_refs, page_links, quoted_url_refs

#: Links of a piece of the pages, which one task walks at once.
PIECE = 500_000
#: monotonically_increasing_id counts rows of a partition in so many bits.
PLACE_BITS = 33
FAR = np.iinfo(np.int64).max


def stored_pages(pages: DataFrame) -> DataFrame:
    """Pages by site and fragment-free URL; the first stored copy of a URL counts."""
    keyed = pages.select("page_id", "html", urls.drop_fragment(F.col("url")).alias("url"))
    return keyed.withColumn("site", urls.netloc(F.col("url")))


def link_closure(pages: DataFrame, start: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages reached from each site's start URLs, at most ``max_pages`` per site if given.

    The text of the pages is read once, for the edges between stored pages. Returns ``site, url, depth``.
    """
    stored = reliable_checkpoint(stored_pages(pages).select("site", "url").distinct())
    links = page_links(pages.withColumn("url", urls.drop_fragment(F.col("url")))).select("url", "link").distinct()
    # a link without a stored page leads nowhere: checked once, not in every level
    edges = links.join(stored.select(F.col("url").alias("link"), F.col("site").alias("link_site")), "link")
    first = start.select(urls.drop_fragment(F.col("url")).alias("url")).distinct().join(stored, "url")
    return _whole(stored, edges, first) if max_pages is None else _by_levels(edges, first, max_pages)


def _by_levels(edges: DataFrame, first: DataFrame, max_pages: int) -> DataFrame:
    """Pages are taken level by level and by URL within a level.

    Edges and the pages reached so far are tables in buckets of their URL: a level reads them where they lie and moves
    only its frontier and what that links to. How many pages a site has is carried along in the frontier.
    """
    spark = edges.sparkSession
    name = f"webtally_closure_{uuid.uuid4().hex}"
    edges = _append(edges, f"{name}_edges")
    frontier = _taken(first.withColumn("used", F.lit(0).cast("bigint")), max_pages)
    frontier = reliable_checkpoint(frontier.withColumn("depth", F.lit(0)))
    reached = _append(frontier.select("site", "url", "depth"), f"{name}_reached")
    for depth in range(1, max_pages):
        found = (
            frontier.select("url", "used").join(edges, "url")
            .groupBy(F.col("link").alias("url"), F.col("link_site").alias("site")).agg(F.max("used").alias("used"))
        )
        new = found.join(reached.select("url"), "url", "left_anti")
        frontier = reliable_checkpoint(_taken(new, max_pages).withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = _append(frontier.select("site", "url", "depth"), f"{name}_reached")
    result = reliable_checkpoint(reached)
    for table in ("edges", "reached"):
        spark.sql(f"DROP TABLE {name}_{table}")
    return result


def _append(df: DataFrame, name: str, key: str = "url") -> DataFrame:
    """The table ``name``, in buckets of ``key``, with the rows of ``df`` added."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.mode("append").bucketBy(n, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def _taken(found: DataFrame, max_pages: int) -> DataFrame:
    """The pages a site still takes, by URL, and with them how many it has then (``used``)."""
    by_url = Window.partitionBy("site").orderBy("url")
    ranked = found.withColumn("rank", F.row_number().over(by_url)).where(F.col("rank") <= max_pages)
    # links between sites bring the count of another site: the largest of the site's own counts
    taken = ranked.withColumn("used", F.max("used").over(Window.partitionBy("site"))).where(F.col("rank") + F.col("used") <= max_pages)
    return taken.withColumn("used", F.col("used") + F.count("*").over(Window.partitionBy("site"))).select("site", "url", "used")


def _whole(stored: DataFrame, edges: DataFrame, first: DataFrame, piece: int = PIECE) -> DataFrame:
    """Everything that links lead to, in rounds of pieces instead of levels.

    Pages lie in pieces of neighbouring URLs with some ``piece`` links each. A piece knows the pages it was entered at and
    from there goes all levels by itself; a round carries on only the links that leave a piece and come in at a smaller
    depth than known. So there are as many rounds as a shortest way changes pieces, however many levels it has.
    """
    spark = stored.sparkSession
    name = f"webtally_closure_{uuid.uuid4().hex}"
    linked = reliable_checkpoint(edges.select("url", "link"))
    n = max(1, math.ceil(max(linked.count(), stored.count()) / piece))
    # the number of a page is that of its piece, then its place in the piece
    pages = reliable_checkpoint(stored.repartitionByRange(n, "site", "url").select("site", "url", F.monotonically_increasing_id().alias("node")))
    number = pages.select("url", "node")
    numbered = linked.join(number.withColumnRenamed("node", "src"), "url").join(number.select(F.col("url").alias("link"), F.col("node").alias("dst")), "link")
    table = _append(numbered.select(_piece_of("src").alias("piece"), "src", "dst"), f"{name}_edges", "piece")
    entered = reliable_checkpoint(first.join(number, "url").select("node", F.lit(0).alias("depth")))
    new = entered
    while not new.isEmpty():
        active = new.select(_piece_of("node").alias("piece")).distinct()
        here = entered.join(F.broadcast(active), _piece_of("node") == F.col("piece"), "left_semi")
        out = _in_pieces(table.join(F.broadcast(active), "piece", "left_semi"), here, True)
        before = entered.withColumnRenamed("depth", "before")
        better = out.groupBy("node").agg(F.min("depth").alias("depth")).join(before, "node", "left")
        new = reliable_checkpoint(better.where("before IS NULL OR depth < before").select("node", "depth"))
        entered = reliable_checkpoint(entered.unionByName(new).groupBy("node").agg(F.min("depth").alias("depth")))
    result = reliable_checkpoint(pages.join(_in_pieces(table, entered, False), "node").select("site", "url", "depth"))
    spark.sql(f"DROP TABLE {name}_edges")
    return result


def _piece_of(node: str) -> Column:
    return F.shiftright(node, PLACE_BITS)


def _in_pieces(edges: DataFrame, entered: DataFrame, leaving: bool) -> DataFrame:
    """``node, depth`` of the pages that the entered pages of each piece lead to: those in it, or those links leave it for."""

    def walk(links: pa.Table, entries: pa.Table) -> pa.Table:
        node, at = entries["node"].to_numpy(), entries["depth"].to_numpy()
        src, dst = links["src"].to_numpy(), links["dst"].to_numpy()
        if not len(node):
            return pa.table({"node": pa.array([], pa.int64()), "depth": pa.array([], pa.int32())})
        base = node[0] >> PLACE_BITS << PLACE_BITS
        inside = (dst >> PLACE_BITS << PLACE_BITS) == base
        depth = depths(src[inside] - base, dst[inside] - base, node - base, at)
        if leaving:
            src, dst = src[~inside] - base, dst[~inside]
            known = src < len(depth)
            src, dst = src[known], dst[known]
            src, dst = src[depth[src] < FAR], dst[depth[src] < FAR]
            order = np.lexsort((depth[src], dst))
            out, first = np.unique(dst[order], return_index=True)
            found = depth[src][order][first] + 1
        else:
            out = np.flatnonzero(depth < FAR)
            found, out = depth[out], out + base
        return pa.table({"node": out.astype(np.int64), "depth": found.astype(np.int32)})

    by_piece = entered.select(_piece_of("node").alias("piece"), "node", "depth").groupBy("piece")
    return edges.groupBy("piece").cogroup(by_piece).applyInArrow(walk, "node bigint, depth int")


def depths(src: np.ndarray, dst: np.ndarray, start: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Depth of every place that links ``src`` to ``dst`` reach from places ``start`` at depths ``at``; ``FAR`` for others."""
    size = int(max(src.max(initial=0), dst.max(initial=0), start.max())) + 1
    order = np.argsort(src, kind="stable")
    dst = dst[order]
    ends = np.cumsum(np.bincount(src, minlength=size))
    depth = np.full(size, FAR, np.int64)
    order = np.argsort(at, kind="stable")
    start, at = start[order], at[order]
    level, taken, frontier = int(at[0]), 0, np.zeros(0, np.int64)
    while len(frontier) or taken < len(start):
        if not len(frontier):
            level = int(at[taken])
        until = int(np.searchsorted(at, level, "right"))
        frontier = np.unique(np.concatenate([frontier, start[taken:until]]))
        frontier, taken = frontier[depth[frontier] == FAR], until
        depth[frontier] = level
        begin = np.where(frontier > 0, ends[frontier - 1], 0)
        many = ends[frontier] - begin
        at_link = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        found = dst[at_link]
        frontier, level = found[depth[found] == FAR], level + 1
    return depth


def closure_static_refs(pages: DataFrame, reached: DataFrame) -> DataFrame:
    """Distinct static references of the reached pages."""
    # only pages in the closure are parsed
    chosen = stored_pages(pages).join(reached.select("url"), "url", "left_semi")
    tagged = html_refs(chosen).where(F.col("kind").isin("script", "link"))
    return (
        tagged.select("url", "target")
        .unionByName(quoted_url_refs(chosen).select("url", "target"))
        .select(urls.netloc(F.col("url")).alias("site"), "target")
        .distinct()
    )
