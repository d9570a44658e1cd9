"""Clustering of integer vectors around centroids, exact to the last unit.

Distances are screened in single precision: one matrix product gives all scores of a batch, and a bound on its rounding
error gives an interval around each. A centroid whose interval lies above another's can't be nearest. Where one centroid is
left it is the nearest; where intervals overlap, the distances of those left are taken in integers, and the smallest
number wins a tie. So the result is that of integer arithmetic, whatever the CPU, the batch or the order of rows.

A round reads the packed vectors and gives one row per task and cluster; sums meet in one aggregation, and the driver
holds k centroids.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import Scratch
from .whitening import grid_vectors

#: Half a unit in the last place of single precision.
_UNIT = 2.0**-24


def largest_entry(dims: int) -> int:
    """Entries up to this, in absolute value, have squared distances that a long can hold."""
    return 1 << (62 - max(0, math.ceil(math.log2(dims)))) // 2 - 1


def screen(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest to each row: a mask that never leaves the nearest ones out.

    |x|^2 is the same for all centroids, so |c|^2 - 2 x c is compared. Turning whole numbers into single precision and
    summing ``dims`` products in any order, with or without fused operations, is wrong by at most g * |x| * |c|, with
    g = m u / (1 - m u) and m = dims + 2; the rest of the bound is for double precision."""
    m = x.shape[1] + 2
    g = m * _UNIT / (1 - m * _UNIT) * (1 + 2.0**-20)
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    square = (centroids * centroids).sum(axis=1).astype(np.float64)
    wide = x.astype(np.float64)
    size = np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None] * np.sqrt(square)
    score = square - 2 * product
    error = 2 * g * size + 2.0**-50 * (square + 2 * size)
    return ~(score - error > (score + error).min(axis=1, keepdims=True))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row; the smallest of equally near ones."""
    may = screen(x, centroids)
    out = may.argmax(axis=1)
    open_ = np.flatnonzero(may.sum(axis=1) > 1)
    if len(open_):
        row, c = np.nonzero(may[open_])
        far = x[open_[row]] - centroids[c]
        exact = np.full((len(open_), len(centroids)), np.iinfo(np.int64).max)
        exact[row, c] = (far * far).sum(axis=1)
        out[open_] = exact.argmin(axis=1)
    return out


def pack_vectors(grid: DataFrame, dims: int) -> DataFrame:
    """(vec_id, x) with x as the bytes of 32-bit integers."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.ascontiguousarray(b.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i4"))
                ends = pa.py_buffer(np.arange(b.num_rows + 1, dtype=np.int32) * (4 * dims))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends, pa.py_buffer(x)])], names=["vec_id", "x"])

    return grid.mapInArrow(run, "vec_id long, x binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a batch as 64-bit integers."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "<i4")[ends[0] // 4 : ends[-1] // 4].reshape(len(column), dims).astype(np.int64)


def _sums(packed: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each cluster that has vectors their number and the sum of each component."""
    k, dims = centroids.shape

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"), dims)
                of = nearest(x, centroids)
                order = np.argsort(of, kind="stable")
                which, at = np.unique(of[order], return_index=True)
                total[which] += np.add.reduceat(x[order], at, axis=0)
                count += np.bincount(of, minlength=k)
        have = np.flatnonzero(count)
        ends = pa.array(np.arange(len(have) + 1, dtype=np.int32) * dims)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(count[have]), pa.ListArray.from_arrays(ends, pa.array(total[have].ravel()))], names=["cluster", "n", "s"])

    rows = packed.select("x").mapInArrow(run, "cluster int, n long, s array<long>")
    found = rows.groupBy("cluster").agg(F.expr("sum(n)"), *(F.expr(f"sum(s[{i}])") for i in range(dims))).collect()
    return {r[0]: (r[1], list(r[2:])) for r in found}


@dataclass(frozen=True)
class Clusters:
    """``centroids`` after the last round; ``inertia``: squared distances summed over each cluster, in order."""

    centroids: np.ndarray
    inertia: list[int]

    def digest(self, i: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[i].tolist())).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: float = 1024.0, seed: str = "3") -> tuple[Clusters, DataFrame]:
    """Lloyd's rounds on integer vectors: the clusters, and (vec_id, cluster, distance) for each vector, with its squared
    distance. Component c counts as floor(scale * c). The first centroids are the vectors with the k smallest hashes
    of ``seed`` and id; a round replaces each centroid that has vectors by the floor of their mean.

    Rounds end early when no centroid has changed, since later ones would change nothing.

    Defined cases: vectors that are null, of another length, or hold null or non-finite entries have no row; ids may be
    repeated (equal hashes are ordered by the vector) or null (such vectors are first centroids only if there are fewer
    than k others, ordered by the vector); with fewer than k vectors there are as many centroids; scaled components
    saturate at the largest number whose distances fit a long (2^27 for 64 dimensions); other columns are ignored,
    whatever their names; an empty table gives an empty result."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    packed = scratch.put(pack_vectors(grid_vectors(vectors, id_col, vector_col, dims, scale, 0, float(largest_entry(dims) - 1)), dims), "packed")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = packed.orderBy(rank.asc_nulls_last(), "x").limit(k).select("x").collect()
    centroids = np.array([np.frombuffer(r[0], "<i4") for r in first], np.int64).reshape(len(first), dims)
    for _ in range(rounds if len(first) else 0):
        moved = centroids.copy()
        for i, (n, sums) in _sums(packed, centroids).items():
            moved[i] = [s // n for s in sums]
        if (moved == centroids).all():
            break
        centroids = moved

    def assign(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"), dims)
                of = nearest(x, centroids)
                far = x - centroids[of]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(of.astype(np.int32)), pa.array((far * far).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    placed = scratch.put(packed.mapInArrow(assign, "vec_id long, cluster int, distance long"), "placed")
    totals = {r[0]: int(r[1]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20, 0)"))).collect()}
    scratch.keep("placed")
    return Clusters(centroids, [totals.get(i, 0) for i in range(len(first))]), placed
