"""Integer k-means whose assignments are found by the threshold algorithm (operator 13).

Each dimension has the list of its centroid values, sorted. A vector walks every list outward from its own value, one
centroid a step on the nearer side. A centroid met for the first time gets its exact squared distance. The squared gaps to
the next centroids of all lists, summed, bound the distance of every centroid not met yet: where that sum is strictly
greater than the best exact distance, none of them can be nearer or as near, and the vector is done. Vectors of a batch take
their steps together.

Rows take part whose vector has exactly ``dim`` components, none null or not finite; a component becomes the integer
``floor(scale * x)``. Rows whose vector is left out have no result. Null ids are hashed as the empty string; rows that repeat
are vectors of their own, and where they tie for a first centroid the one with the smaller components comes first. Fewer
vectors than ``k`` give fewer centroids, an empty table an empty result; other columns are ignored. Components
must stay below 2**25 after scaling, so that distances are exact 64-bit integers; larger ones raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written

LARGEST = 1 << 25
#: Vectors that walk together.
TOGETHER = 4096


def finite(vector):
    """Whether an array column is there and has only finite components; NaN is greater than infinity here."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def integer_vectors(rows: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``q``, the integer components, of the rows that take part."""
    named = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector"))
    kept = named.filter(F.coalesce((F.size("vector") == dim) & finite(F.col("vector")), F.lit(False)))
    parts = F.transform("vector", lambda x: F.floor(x.cast("double") * scale))
    within = F.when(
        F.forall("q", lambda x: F.abs(x) < LARGEST), F.col("q")
    ).otherwise(F.raise_error(F.lit(f"a component exceeds {LARGEST} after scaling")))
    return kept.select("vec_id", parts.alias("q")).select("vec_id", within.alias("q"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``, in the order of the hashes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), "q").orderBy("digest", "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (the smaller number among equals), its squared distance, and the distances computed."""
    n, (k, dim) = len(vectors), centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable").T  # by dimension: centroids in the order of their values
    values = np.take_along_axis(centroids.T, order, axis=1)
    # one centroid beyond each end, so far off that a walk that has used up one side goes on along the other
    far = np.int64(1) << np.int64(28)
    padded = np.concatenate([np.full((dim, 1), -far), values, np.full((dim, 1), far)], axis=1)
    right = np.empty((n, dim), np.int64)
    for d in range(dim):
        right[:, d] = np.searchsorted(values[d], vectors[:, d]) + 1
    left = right - 1
    best, owner = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    met = np.zeros((n, k), bool)
    walking, dims, computed = np.arange(n), np.arange(dim)[None, :], 0
    for _ in range(k):
        x, l, r = vectors[walking], left[walking], right[walking]
        down = x - padded[dims, l] <= padded[dims, r] - x
        seen = order[dims, np.where(down, l, r) - 1]
        fresh = np.zeros((len(walking), k), bool)
        fresh[np.arange(len(walking))[:, None], seen] = True
        fresh &= ~met[walking]
        met[walking] |= fresh
        row, centroid = np.nonzero(fresh)  # by row, then by number: the first among equals has the smaller number
        computed += len(row)
        distance = np.square(x[row] - centroids[centroid]).sum(1)
        # both ways to compare at once: distance first, then the number of the centroid
        here = walking[row]
        for turn in range(int(fresh.sum(1).max(initial=0))):
            pick = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == turn)
            at = here[pick]
            better = (distance[pick] < best[at]) | ((distance[pick] == best[at]) & (centroid[pick] < owner[at]))
            best[at[better]], owner[at[better]] = distance[pick][better], centroid[pick][better]
        l, r = np.where(down, l - 1, l), np.where(down, r, r + 1)
        left[walking], right[walking] = l, r
        gap = np.minimum(x - padded[dims, l], padded[dims, r] - x)
        frontier = np.where((l < 1) & (r > k), 0, gap)
        # a list that is used up has shown every centroid
        walking = walking[(np.square(frontier).sum(1) <= best[walking]) & ~met[walking].all(1)]
        if not len(walking):
            break
    return owner, best, computed


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _walks(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            vectors = _vectors(part)
            yield part, vectors, *nearest(vectors, centroids)[:2]


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each the exact floor of the mean of its vectors, those without vectors as they were."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, part, owner, _ in _walks(batches, centroids):
            np.add.at(sums, owner, part)
            counts += np.bincount(owner, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"]
        )

    # one row a cluster and task; of these, sums of (cluster, dimension): a table of k * dim rows, whatever the input
    parts = vectors.mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d")
    out = centroids.copy()
    for row in cells.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():
        out[row["cluster"], row["d"]] = int(row["s"]) // row["n"]
    return out


def cluster(
    rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, the inertia of the cluster and of all, and a digest of the centroid, for every vector."""
    vectors = written(integer_vectors(rows, dim, scale, id_col, vector_col), "integer-vectors")
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, owner, distance in _walks(batches, centroids):
            columns = [part.column("vec_id"), pa.array(owner.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    assigned = written(vectors.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"), "assigned")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # at most k rows
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    about = [(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    about = rows.sparkSession.createDataFrame(about, schema)
    return assigned.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
