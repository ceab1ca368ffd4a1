"""Nearest-centroid clustering of vectors in whole numbers, filtered by rotated coordinates.

A vector's components become floor(scale * x). All that decides (distances, ties, centroids) is computed in integers;
floating point only says which centroids can't be the nearest one.

PCA-rotated filtering: the covariance of all vectors is summed by tasks and its eigenvectors rotate space, so that the
first coordinates hold most of a distance. Each vector is stored with its ``leading`` first rotated coordinates and the
norm of the rest. For a vector and a centroid, the squared distance of the leading coordinates plus the squared
difference of the norms of the rest is never above their squared distance. The centroid with the smallest bound is
verified first; of the others only those whose bound (less a slack for rounding) isn't above the distance found so far.

A round is one pass over the stored vectors: each task sends a count and a sum of components for each centroid, Spark
adds them up, and the driver holds the ``k`` centroids alone. Nothing is dealt by cluster, so that a cluster of any size,
or a vector that is repeated any number of times, is no task's burden.

Defined results: vectors that are null, of another length, or with a null, NaN or infinite component aren't kept; a
component beyond LARGEST in absolute value (after scaling) counts as LARGEST, so that squared distances fit in 64 bits;
repeated rows are vectors each; a null id is returned and is never chosen to begin with before all others; ties go to
the smaller centroid, equal hashes to the smaller vector; with fewer vectors than ``k`` there are as many centroids; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import cut

#: Components are at most so large: 64 squares of twice this are below 2^63.
LARGEST = (1 << 27) - 1
#: Rounding of bounds, relative to the squared norms of which they are made.
SLACK = 1e-9
MOST_LONG = (1 << 63) - 1


def whole_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64
) -> DataFrame:
    """vec_id, v: the kept vectors as floor(scale * x)."""
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(
        "x", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    )
    return given.where((F.size("x") == dims) & finite).select("vec_id", whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


@dataclass
class Rotation:
    """x to (x - mean) . turn, of which ``leading`` coordinates are kept."""

    mean: np.ndarray
    turn: np.ndarray
    leading: int

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leading coordinates and the norm of the rest."""
        turned = (x - self.mean) @ self.turn
        return turned[:, : self.leading], np.sqrt(np.square(turned[:, self.leading :]).sum(axis=1))


def rotation(kept: DataFrame, *, dims: int, leading: int) -> Rotation:
    """The principal axes of all vectors, the longest first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            x = np.hstack((np.ones((len(batch), 1)), _matrix(batch.column("v"), dims)))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), _lists(total)], ["i", "row"])

    rows = kept.select("v").mapInArrow(moments, "i int, row array<double>")
    sums = rows.select("i", F.posexplode("row").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s"))
    total = np.zeros((dims + 1, dims + 1))
    for r in sums.collect():  # (dims + 1)^2 numbers
        total[r["i"], r["j"]] = r["s"]
    n = max(1.0, total[0, 0])
    mean = total[0, 1:] / n
    _, axes = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))
    return Rotation(mean, np.ascontiguousarray(axes[:, ::-1]), min(leading, dims))


def rotated(kept: DataFrame, turn: Rotation) -> DataFrame:
    """vec_id, v, lead, rest: the vectors with what bounds their distances."""
    dims = len(turn.mean)
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("lead", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = turn.apply(_matrix(batch.column("v"), dims).astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(lead), pa.array(rest)], schema.names)

    return kept.mapInArrow(run, schema)


def nearest(
    v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turn: Rotation
) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each vector the nearest centroid and the squared distance; the number of distances computed."""
    c_lead, c_rest = turn.apply(centroids.astype(float))
    ours, theirs = np.square(lead).sum(axis=1)[:, None], np.square(c_lead).sum(axis=1)
    bound = ours + theirs - 2 * lead @ c_lead.T + np.square(rest[:, None] - c_rest)
    bound -= SLACK * (ours + theirs + np.square(rest)[:, None] + np.square(c_rest)) + 1e-6
    cluster = bound.argmin(axis=1)
    distance = np.square(v - centroids[cluster]).sum(axis=1)
    bound[np.arange(len(v)), cluster] = np.inf
    verified = len(v)
    for j, centroid in enumerate(centroids):
        rows = np.flatnonzero(bound[:, j] <= distance)
        found = np.square(v[rows] - centroid).sum(axis=1)
        better = (found < distance[rows]) | ((found == distance[rows]) & (j < cluster[rows]))
        distance[rows[better]], cluster[rows[better]] = found[better], j
        verified += len(rows)
    return cluster, distance, verified


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, turn: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = _matrix(batch.column("v"), len(turn.mean)).astype(np.int64)
    lead = _matrix(batch.column("lead"), turn.leading)
    cluster, distance, _ = nearest(v, lead, batch.column("rest").to_numpy(), centroids, turn)
    return v, cluster, distance


def _moved(stored: DataFrame, centroids: np.ndarray, turn: Rotation) -> np.ndarray:
    """The floors of the means of the centroids' vectors; a centroid without vectors stays."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v, cluster, _ = _assigned(batch, centroids, turn)
            counts += np.bincount(cluster, minlength=k)
            for j in np.unique(cluster):
                total[j] += v[cluster == j].sum(axis=0)
        some = np.flatnonzero(counts)
        columns = [pa.array(some, pa.int32()), pa.array(counts[some]), _lists(total[some])]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    parts = stored.select("v", "lead", "rest").mapInArrow(sums, "cluster int, n long, sums array<long>")
    whole = (
        parts.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
        .groupBy("cluster", "i")
        .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    )
    new = centroids.copy()
    for r in whole.collect():  # k x dims numbers
        new[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return new


def clusters(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = 64,
    scale: int = 64,
    k: int = 16,
    rounds: int = 3,
    seed: int = 1,
    leading: int = 16,
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) of each kept vector, and the centroids.

    Centroids begin as the ``k`` vectors with the smallest sha256 of ``seed:id``.
    """
    kept = whole_vectors(vectors, id_col=id_col, vector_col=vector_col, dims=dims, scale=scale)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(name.asc_nulls_last(), "v").limit(k).select("v").collect()
    out = T.StructType([kept.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not first:
        return kept.sparkSession.createDataFrame([], out), np.zeros((0, dims), np.int64)
    centroids = np.array([r["v"] for r in first], np.int64)
    turn = rotation(kept, dims=dims, leading=leading)
    stored = cut(rotated(kept, turn))
    for _ in range(rounds):
        centroids = _moved(stored, centroids, turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, distance = _assigned(batch, centroids, turn)
            columns = [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, out.names)

    return cut(stored.mapInArrow(run, out)), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with cluster_inertia and inertia (sums of distances, at most MOST_LONG) and centroid_sha256."""
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    by_cluster = {r["cluster"]: int(r["s"]) for r in sums.collect()}  # one row a centroid
    whole = min(MOST_LONG, sum(by_cluster.values()))
    rows = [
        (j, min(MOST_LONG, by_cluster.get(j, 0)), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for j, c in enumerate(centroids.tolist())
    ]
    about = found.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", *about.columns[1:])
