"""Hard negatives by an inverted multi-index (operator 11).

Vectors are cut in two halves, each with a codebook; the two codes of a vector name its cell. For a query, half a code word
``c`` with radius ``r`` (the distance of its farthest vector, over all rows) bounds the half score of all its vectors by
``<a, c> + |a| r``. The multi-sequence heap visits cells in the order of the two bounds' sum, so once the next sum is below
what a query still looks for, its results are certain: it has seen every row that could be among them.

A query looks for rows through *wants*: the same or another label, a window of scores, and how many. First the positives
(no window), then, their scores known, the negatives of every positive, each in its window.

Cells are packed into tiles of at most ``TILE`` vectors, a larger cell into several; a tile is one task's index. Queries go
first to the tile of their best cell, which tells what is worth looking for, then to the tiles whose bound reaches that.
A tile that very many queries reach is copied, so that no task answers for all of them. Rows with the same vector and label
score alike and are one point, of which only the smallest ids can be in a result: copies cost nothing. Equal queries are
asked once.

The codebooks are fitted on at most about ``SAMPLE`` points; every point is indexed, and any codebook gives the same result.
On vectors without clusters the radii are wide and most cells are visited.

Left out are rows whose id, label or vector is null, or with a null or non-finite component. A component ``x`` becomes
``floor(scale * x)``; shorter vectors are filled up with zeros. Rows that repeat count once; of rows of one id that differ,
the one with the smallest label, then the smallest components. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .clustering import finite
from .common import mixed, shuffle_partitions, written

#: Points the codebooks are fitted on (about), points in a cell on average, most words of a codebook, points in a tile.
SAMPLE, CELL, WORDS, TILE = 20_000, 512, 1024, 4096
#: Queries that one copy of a tile answers.
ANSWERED = 65_536
#: Rounding of the bounds, which are sums of doubles: they are widened by this share of the norms.
SLACK = 1e-9


def points(rows: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """vec_id, label and ``q``, the integer components, of the rows that take part, one row an id."""
    named = rows.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("vector")
    )
    kept = named.filter(F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")), F.lit(False)))
    whole = kept.select("vec_id", "label", F.transform("vector", lambda x: F.floor(x.cast("double") * scale)).alias("q"))
    return whole.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.label", "row.q")


def _numbers(column: pa.Array, dim: int, width: str) -> np.ndarray:
    """Packed vectors as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), width).reshape(len(column), dim)


def _packed(rows: DataFrame, dim: int, width: str) -> DataFrame:
    """``q`` as bytes, filled up with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("q")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            full = np.zeros((batch.num_rows, dim), width)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            full[row, place] = lists.flatten().to_numpy(zero_copy_only=False)
            packed = pa.array([v.tobytes() for v in full], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed], ["vec_id", "label", "q"])

    return rows.mapInArrow(run, "vec_id bigint, label bigint, q binary")


class MultiIndex:
    """Codebooks of the two halves, their radii, and the tile of every cell."""

    def __init__(self, sample: np.ndarray, n_points: int, width: str):
        self.dim, self.width = sample.shape[1], width
        self.half = (self.dim + 1) // 2
        words = int(min(WORDS, max(1, round((n_points / CELL) ** 0.5)), max(1, len(sample))))
        self.words = [self._fitted(part.astype(float), words) for part in self.halves(sample)]
        self.radii = [np.zeros(words), np.zeros(words)]

    def halves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return q[:, : self.half], q[:, self.half :]

    @staticmethod
    def _codes(part: np.ndarray, words: np.ndarray) -> np.ndarray:
        out = np.empty(len(part), np.int64)
        for at in range(0, len(part), 4096):
            out[at : at + 4096] = (np.square(words).sum(1) - 2 * part[at : at + 4096] @ words.T).argmin(1)
        return out

    def _fitted(self, part: np.ndarray, words: int) -> np.ndarray:
        centres = part[np.linspace(0, len(part) - 1, words).astype(int)].copy() if len(part) else np.zeros((words, part.shape[1]))
        for _ in range(8):
            codes = self._codes(part, centres)
            for w in np.unique(codes):
                centres[w] = part[codes == w].mean(0)
        return centres

    def codes(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The word of each half and the distance to it."""
        found, apart = [], []
        for part, words in zip(self.halves(q.astype(float)), self.words):
            found.append(self._codes(part, words))
            apart.append(np.sqrt(np.square(part - words[found[-1]]).sum(1)))
        return found, apart

    def bounds(self, q: np.ndarray) -> list[np.ndarray]:
        """Upper bounds of the half scores of each query with each word of each half."""
        out = []
        for part, words, radii in zip(self.halves(q.astype(float)), self.words, self.radii):
            norm = np.sqrt(np.square(part).sum(1))[:, None]
            wide = norm * (np.sqrt(np.square(words).sum(1)) + radii + 1)
            out.append(part @ words.T + norm * radii + SLACK * wide)
        return out

    def pack(self, one: np.ndarray, two: np.ndarray, counts: np.ndarray) -> None:
        """Tiles: neighbouring cells together up to ``TILE`` points, a cell with more split by the hash of its points."""
        shape = (len(self.words[0]), len(self.words[1]))
        self.first, self.parts = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
        cells, starts, room = [], [], 0
        for i, j, n in sorted(zip(one.tolist(), two.tolist(), counts.tolist())):
            pieces = -(-n // TILE)
            if n > room:
                self.first[i, j] = len(starts)
                starts += range(len(cells), len(cells) + pieces)
                cells += [(i, j)] * pieces
                room = TILE - n if pieces == 1 else 0
            else:
                self.first[i, j] = len(starts) - 1
                cells.append((i, j))
                room -= n
            self.parts[i, j] = pieces
        self.one, self.two = np.array(cells, np.int64).reshape(-1, 2).T
        self.starts = np.array(starts, np.int64)

    def tile_bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and tile the largest sum of bounds of the tile's cells."""
        one, two = self.bounds(q)
        return np.maximum.reduceat(one[:, self.one] + two[:, self.two], self.starts, axis=1)


def _located(nodes: DataFrame, index: MultiIndex, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch, *index.codes(_numbers(batch.column("q"), index.dim, index.width)))

    return nodes.mapInArrow(run, schema)


def build_index(nodes: DataFrame, n_points: int, dim: int, width: str) -> MultiIndex:
    """Codebooks from a sample, radii and cell sizes from all points."""
    step = max(1, n_points // SAMPLE)
    sample = nodes.filter(F.pmod(F.xxhash64("q", "label"), F.lit(step)) == 0).orderBy("q", "label").select("q").toArrow()
    index = MultiIndex(_numbers(sample["q"], dim, width), n_points, width)

    def one_row(batch, codes, apart):
        columns = [pa.array(c, pa.int32()) for c in codes] + [pa.array(a) for a in apart]
        return pa.RecordBatch.from_arrays(columns, ["one", "two", "r_one", "r_two"])

    placed = _located(nodes, index, "one int, two int, r_one double, r_two double", one_row)
    # at most WORDS * WORDS rows
    cells = placed.groupBy("one", "two").agg(F.count("*").alias("n"), F.max("r_one").alias("r_one"), F.max("r_two").alias("r_two")).toArrow()
    for half, (code, radius) in enumerate((("one", "r_one"), ("two", "r_two"))):
        np.maximum.at(index.radii[half], cells[code].to_numpy(), cells[radius].to_numpy() * (1 + SLACK))
    index.pack(*(cells[c].to_numpy() for c in ("one", "two", "n")))
    return index


def tiled(nodes: DataFrame, index: MultiIndex) -> DataFrame:
    """Every point with its tile."""

    def run(batch, codes, _):
        place = (mixed(batch.column("node").to_numpy().astype(np.uint64)) >> np.uint64(33)).astype(np.int64)
        tile = index.first[codes[0], codes[1]] + place % index.parts[codes[0], codes[1]]
        columns = [pa.array(tile, pa.int32()), *(batch.column(c) for c in ("node", "label", "q", "ids"))]
        return pa.RecordBatch.from_arrays(columns, ["tile", "node", "label", "q", "ids"])

    return _located(nodes, index, "tile int, node bigint, label bigint, q binary, ids array<bigint>", run)


class Tile:
    """The points of one tile by cell, and the search of one query in it."""

    def __init__(self, index: MultiIndex, label: np.ndarray, q: np.ndarray, ids: list[list[int]], whole: type):
        codes, _ = index.codes(q)
        order = np.lexsort((codes[1], codes[0]))
        self.index, self.label, self.q, self.ids = index, label[order], q[order].astype(whole), [ids[i] for i in order]
        cells = np.column_stack(codes)[order]
        starts = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]).any(1))))
        stops = np.append(starts[1:], len(cells))
        self.rows = {tuple(cells[a].tolist()): slice(int(a), int(b)) for a, b in zip(starts, stops)}
        self.one, self.two = np.unique(cells[:, 0]), np.unique(cells[:, 1])

    def cells(self, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[float, slice]]:
        """Multi-sequence: the cells by the sum of their half bounds, largest first, with that sum."""
        a, b = self.one[np.argsort(-one[self.one], kind="stable")], self.two[np.argsort(-two[self.two], kind="stable")]
        heap, waiting = [(-(one[a[0]] + two[b[0]]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            rows = self.rows.get((int(a[i]), int(b[j])))
            if rows is not None:
                yield -bound, rows
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in waiting:
                    waiting.add((x, y))
                    heapq.heappush(heap, (-(one[a[x]] + two[b[y]]), x, y))

    def answer(self, q: np.ndarray, label: int, wants: list[dict], one: np.ndarray, two: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(want, score, id): for each want its best, as many as it asks for."""
        found: list[list[tuple[int, int]]] = [[] for _ in wants]
        least = [w["low"] for w in wants]
        open_ = list(range(len(wants)))
        for bound, rows in self.cells(one, two):
            # a window is certified once no cell that is left reaches its least score
            open_ = [w for w in open_ if bound >= least[w]]
            if not open_:
                break
            score = self.q[rows] @ q
            same = self.label[rows] == label
            for w in open_:
                want = wants[w]
                hit = np.flatnonzero((same if want["same"] else ~same) & (score >= least[w]) & (score <= want["high"]))
                for row in hit[np.argsort(-score[hit], kind="stable")].tolist():
                    value = int(score[row])
                    if value < least[w]:
                        break
                    for i in self.ids[rows.start + row]:
                        insort(found[w], (-value, i))
                    del found[w][want["k"] :]
                    if len(found[w]) == want["k"]:
                        least[w] = max(want["low"], -found[w][-1][0])
        for want, best in zip(wants, found):
            yield from ((want["want"], -negative, i) for negative, i in best)


def _answers(asked: DataFrame, tiles: DataFrame, index: MultiIndex, whole: type) -> DataFrame:
    """node, want, score, id: what each tile has for the queries sent to it (tile, node, label, q, wants)."""
    copies = asked.groupBy("tile").agg(F.ceil(F.count("*") / ANSWERED).cast("int").alias("copies"))
    none = F.lit(None)
    index_rows = tiles.join(copies, "tile").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"), F.lit(0).alias("kind"), "node", "label", "q", "ids", none.alias("wants")
    )
    questions = asked.join(copies, "tile").select(
        "tile", F.pmod(F.xxhash64("node"), "copies").cast("int").alias("part"), F.lit(1).alias("kind"), "node", "label", "q", none.alias("ids"), "wants"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, tile = [], None, None
        for batch in batches:
            ends = np.column_stack([batch.column(c).to_numpy() for c in ("tile", "part", "kind")])
            cuts = np.flatnonzero(np.concatenate(([True], (ends[1:] != ends[:-1]).any(1)))) if len(ends) else []
            for a, b in zip(cuts, [*cuts[1:], len(ends)]):
                piece, kind = batch.slice(int(a), int(b - a)), int(ends[a, 2])
                if tuple(ends[a, :2]) != current:
                    current, held, tile = tuple(ends[a, :2]), [], None
                if kind == 0:
                    held.append(piece)
                    continue
                if tile is None:
                    label = np.concatenate([h.column("label").to_numpy() for h in held])
                    q = np.concatenate([_numbers(h.column("q"), index.dim, index.width) for h in held])
                    tile = Tile(index, label, q, [i for h in held for i in h.column("ids").to_pylist()], whole)
                    held = []
                q = _numbers(piece.column("q"), index.dim, index.width)
                one, two = index.bounds(q)
                out: tuple[list, ...] = ([], [], [], [])
                for r, (node, label, wants) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("node", "label", "wants")))):
                    for answer in tile.answer(q[r].astype(whole), label, wants, one[r], two[r]):
                        for column, value in zip(out, (node, *answer)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["node", "want", "score", "id"]
                )

    dealt = index_rows.unionByName(questions).select("tile", "part", "kind", "node", "label", "q", "ids", "wants")
    dealt = dealt.repartition(shuffle_partitions(dealt.sparkSession), "tile", "part").sortWithinPartitions("tile", "part", "kind")
    return dealt.mapInArrow(run, "node bigint, want int, score bigint, id bigint")


def _best(answers: DataFrame, wants: DataFrame) -> DataFrame:
    """Of each want as many as it asks for, higher scores first, then smaller ids."""
    order = Window.partitionBy("node", "want").orderBy(F.desc("score"), "id")
    asked = wants.select("node", F.inline("wants")).select("node", "want", "k")
    ranked = answers.withColumn("rank", F.row_number().over(order))
    return ranked.join(asked, ["node", "want"]).filter(F.col("rank") <= F.col("k")).select("node", "want", "rank", "score", "id")


def search(queries: DataFrame, tiles: DataFrame, index: MultiIndex, whole: type) -> DataFrame:
    """node, want, rank, score, id for queries (node, label, q, wants) against all points."""

    def sent(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                few = max(1, (1 << 22) // len(index.one))
                for at in range(0, batch.num_rows, few):
                    part = batch.slice(at, few)
                    bounds = index.tile_bounds(_numbers(part.column("q"), index.dim, index.width))
                    home = bounds.argmax(1)
                    if first:
                        row, tile = np.arange(len(home)), home
                    else:
                        low = np.array([min(w["low"] for w in wants) for wants in part.column("wants").to_pylist()])
                        goes = bounds >= low[:, None]
                        goes[np.arange(len(home)), home] = False
                        row, tile = np.nonzero(goes)
                    take = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tile, pa.int32()), *(take.column(c) for c in ("node", "label", "q", "wants"))], ["tile", "node", "label", "q", "wants"]
                    )

        return run

    schema = "tile int, node bigint, label bigint, q binary, wants array<struct<want:int,same:boolean,low:bigint,high:bigint,k:int>>"
    queries = written(queries, "queries")
    home = written(_answers(written(queries.mapInArrow(sent(True), schema), "asked"), tiles, index, whole), "answers")
    # what is left to look for: nothing below the last of as many rows as are wanted
    last = _best(home, queries).groupBy("node", "want").agg(F.count("*").alias("n"), F.min("score").alias("last"))
    wants = queries.select("node", F.inline("wants")).join(last, ["node", "want"], "left")
    low = F.when(F.col("n") == F.col("k"), F.greatest("low", "last")).otherwise(F.col("low"))
    narrowed = wants.groupBy("node").agg(F.collect_list(F.struct("want", "same", low.alias("low"), "high", "k")).alias("wants"))
    rest = written(queries.drop("wants").join(narrowed, "node").mapInArrow(sent(False), schema), "asked")
    return written(_best(home.unionByName(_answers(rest, tiles, index, whole)), queries), "found")


def mine(
    rows: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on ``vec_id``. Every anchor has its ``positives`` best rows of the same label; each of them
    the ``negatives`` best rows of another label whose score is within ``window`` percent of the positive's.
    """
    spark = rows.sparkSession
    kept = points(rows, scale, id_col, label_col, vector_col)
    size = kept.agg(F.max(F.size("q")).alias("dim"), F.max(F.array_max(F.transform("q", lambda x: F.abs(x)))).alias("top")).first()
    dim, top = max(1, size["dim"] or 1), size["top"] or 0
    if top * top * dim >= 2**63:
        raise ValueError("scores would not fit 64 bits")
    whole = float if top * top * dim < 2**53 else np.int64  # doubles are exact below 2**53
    width = "<i4" if top < 2**31 else "<i8"
    packed = written(_packed(kept, dim, width), "vectors")
    # of points with the same vector and label only so many can be in one result
    most = max(positives + 1, negatives)
    ranked = packed.withColumn("place", F.row_number().over(Window.partitionBy("q", "label").orderBy("vec_id")))
    nodes = ranked.filter(F.col("place") <= most).groupBy("q", "label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "points")
    index = build_index(nodes, nodes.count(), dim, width)
    if not len(index.starts):
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    tiles = written(tiled(nodes, index), "tiles")

    asking = written(packed.filter(anchors).join(nodes.drop("ids"), ["q", "label"]).select("vec_id", "node"), "anchors")
    queries = nodes.join(asking.select("node").distinct(), "node").select("node", "label", "q")
    far = F.lit(2**62).cast("bigint")
    wanted = F.struct(F.lit(0).alias("want"), F.lit(True).alias("same"), (-far).alias("low"), far.alias("high"), F.lit(positives + 1).alias("k"))
    near = search(queries.withColumn("wants", F.array(wanted)), tiles, index, whole).select("node", "score", "id")

    # the window in whole scores: window[0] * p <= 100 * n <= window[1] * p
    low = f"(score * {window[0]} + pmod(-score * {window[0]}, 100)) div 100 AS low"
    high = f"(score * {window[1]} - pmod(score * {window[1]}, 100)) div 100 AS high"
    windows = near.select("node", "score").distinct().selectExpr("node", "score", low, high).filter("low <= high")
    number = F.row_number().over(Window.partitionBy("node").orderBy("score"))  # at most positives + 1 a query
    windows = written(windows.withColumn("want", number), "windows")
    wants = F.collect_list(F.struct("want", F.lit(False).alias("same"), "low", "high", F.lit(negatives).alias("k")))
    second = queries.join(windows.groupBy("node").agg(wants.alias("wants")), "node")
    apart = search(second, tiles, index, whole).select("node", "want", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    apart = apart.join(windows.select("node", "want", F.col("score").alias("positive_score")), ["node", "want"]).drop("want")

    own = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = asking.join(near, "node").filter(F.col("id") != F.col("vec_id"))
    pairs = pairs.select(F.col("vec_id").alias("anchor_id"), "node", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = pairs.distinct().withColumn("place", F.row_number().over(own)).filter(F.col("place") <= positives).drop("place")
    return pairs.join(apart, ["node", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
