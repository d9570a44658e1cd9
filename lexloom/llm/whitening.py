"""Whitening of embedding vectors from the upper triangle of their covariance.

Vectors become integers on a grid. The covariance of the distinct vectors comes from one aggregation, whose expressions,
a sum of centred products for each pair of dimensions, are generated as SQL. Values are centred at the whole number next
to the mean, so that the sums are exact and don't depend on the order of rows; what is left of the mean is taken out in
Python's integers, which gives each covariance to the last bit. LAPACK decomposes the matrix on the driver; whitened
values are batched matrix products.

The driver holds ``dims`` x ``dims`` numbers, whatever the number of vectors.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import Scratch, quoted, ship_package

#: Scaled entries saturate here, before the offset is added.
_LARGEST = 2.0**31


def finite_vector(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def common_length(vectors: DataFrame, vector_col: str) -> int:
    """The length that most of the finite vectors have; of equally common lengths the larger; 0 if there is no vector."""
    v = F.col(quoted(vector_col)).cast("array<double>")
    found = vectors.where(finite_vector(v) & (F.size(v) > 0)).groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def grid_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: float, offset: int, largest: float = _LARGEST) -> DataFrame:
    """(vec_id, x): the finite vectors of ``dims`` entries, entry c as floor(scale * c) + offset; scaled entries beyond
    +-``largest`` count as +-``largest``."""
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vector_col)).cast("array<double>").alias("v"))
    cell = lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(largest)), F.lit(-largest))).cast("long") + F.lit(offset).cast("long")
    return rows.where(finite_vector(F.col("v")) & (F.size("v") == dims)).select("vec_id", F.transform("v", cell).alias("x"))


def pair_sums(columns: DataFrame) -> dict[tuple[int, int], object]:
    """The sum of products of each pair of columns, i <= j, in one aggregation; None where there is no row."""
    names = [quoted(c) for c in columns.columns]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = columns.selectExpr(*(f"sum({names[i]} * {names[j]}) AS s{i}_{j}" for i, j in pairs)).first()
    return dict(zip(pairs, found))


@dataclass(frozen=True)
class Whitening:
    """``sums`` of the ``n`` distinct vectors; unit eigenvectors (columns of ``vectors``) and eigenvalues ``values`` of
    their covariance, falling, with ``trace``; ``largest`` is the largest distance from the centre in any dimension."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    largest: int
    identity_error: float | None = None

    @property
    def usable(self) -> np.ndarray:
        """Components with a variance beyond rounding."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole numbers next to the means, and what is left of the sums."""
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(near, np.int64), np.array([s - self.n * m for s, m in zip(self.sums, near)], np.int64)

    def apply(self, grid: DataFrame) -> DataFrame:
        """(vec_id, deviation, whitened) of each row (vec_id, x). ``deviation`` is the exact sum of (n * x - sums)^2, null
        where a long can't hold it; components without variance are null in ``whitened``."""
        near, rest = self.centre()
        n, dims, usable = self.n, len(self.sums), self.usable
        turn = np.zeros_like(self.vectors)
        turn[:, usable] = self.vectors[:, usable] / np.sqrt(self.values[usable])
        shift = rest / n if n else rest.astype(float)
        wide = dims * (n * self.largest + n) ** 2 >= 1 << 63

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, dims) - near
                far = x.astype(object) * n - rest.astype(object) if wide else x * n - rest
                square = (far * far).sum(axis=1)
                deviation = pa.array([int(v) if v < 1 << 63 else None for v in square], pa.int64()) if wide else pa.array(square)
                white = (x - shift) @ turn
                mask = np.tile(~usable, b.num_rows)
                ends = np.arange(b.num_rows + 1, dtype=np.int32) * len(usable)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), deviation, pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel(), mask=mask))], names=["vec_id", "deviation", "whitened"])

        return grid.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def _fit(fit: DataFrame, dims: int, components: int) -> Whitening | None:
    """The whitening of the distinct vectors ``fit`` (x); none if there is none."""
    columns = fit.select(*(F.col("x")[i].alias(f"x{i}") for i in range(dims)))
    of = [f"x{i}" for i in range(dims)]
    first = columns.selectExpr("count(*)", *(f"sum(cast({c} AS decimal(20, 0)))" for c in of), *(f"min({c})" for c in of), *(f"max({c})" for c in of)).first()
    n = first[0]
    if not n:
        return None
    sums, low, high = [int(s) for s in first[1 : 1 + dims]], first[1 + dims : 1 + 2 * dims], first[1 + 2 * dims :]
    near = [(2 * s + n) // (2 * n) for s in sums]
    largest = max(max(h - m, m - a) for a, h, m in zip(low, high, near))
    # the cheapest type that holds the sums of products to the last unit; the result is the same
    bound = n * largest * largest
    kind = "double" if bound <= 1 << 53 else "long" if bound < 1 << 63 else "decimal(12, 0)"
    products = pair_sums(columns.selectExpr(*(f"cast(x{i} - {near[i]}L AS {kind}) AS d{i}" for i in range(dims))))
    rest = [s - n * m for s, m in zip(sums, near)]
    cov = np.empty((dims, dims))
    for (i, j), p in products.items():
        cov[i, j] = cov[j, i] = (n * int(p) - rest[i] * rest[j]) / (n * n)  # true division of integers rounds once
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitening(n, sums, vectors * sign, values, float(np.trace(cov)), largest)


def identity_error(white: Whitening, fit: DataFrame) -> float | None:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity, over components with a
    variance, from all rows (x) of ``fit``; None without such a component."""
    usable = np.flatnonzero(white.usable).tolist()
    if not usable:
        return None
    of = white.apply(fit.select(F.lit(None).cast("long").alias("vec_id"), "x"))
    columns = of.select(*(F.col("whitened")[k].alias(f"w{k}") for k in usable), F.lit(1.0).alias("one"))
    sums, last = pair_sums(columns), len(usable)
    mean = [sums[i, last] / white.n for i in range(last)]
    return max(abs(sums[i, j] / white.n - mean[i] * mean[j] - (i == j)) for i in range(last) for j in range(i, last))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: float = 64.0, offset: int = 1_000_000, dims: int | None = None) -> tuple[Whitening | None, DataFrame]:
    """Fits a whitening to the distinct vectors of a table, and applies it to all: the model, and (vec_id, deviation,
    whitened) with an array of at most ``components`` doubles for each row.

    ``dims`` is the length of the vectors, by default the most common one. The covariance takes dims * (dims + 1) / 2
    expressions in one aggregation (2,080 for 64).

    Defined cases: vectors that are null, empty, of another length, or hold null or non-finite entries have no row;
    repeated and null ids are carried through; equal vectors count once in the fit; scaled entries beyond +-2^31
    saturate; components without variance (one distinct vector, dependent dimensions) are null; other columns are
    ignored, whatever their names; without a vector there is no model and the result is empty."""
    ship_package(vectors.sparkSession)
    dims = dims or common_length(vectors, vector_col)
    grid = grid_vectors(vectors, id_col, vector_col, dims, scale, offset)
    scratch = Scratch(vectors.sparkSession, "whitening")
    fit = scratch.put(grid.select("x").distinct(), "fit")
    white = _fit(fit, dims, min(components, dims)) if dims else None
    if white is None:
        scratch.close()
        return None, grid.select("vec_id", F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")).where("1 = 0")
    white = dataclasses.replace(white, identity_error=identity_error(white, fit))
    scratch.close()
    return white, white.apply(grid)
