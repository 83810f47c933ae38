"""Whitening of embeddings on their leading principal components, by a matrix-free block Lanczos method.

The covariance V is never formed.  A pass over the distinct vectors gives V Q for a block Q of few columns: every task adds up y (y'Q)
of its own centred vectors y, and Spark adds up what tasks found, one number for each dimension and column.  The driver keeps the basis
(dimensions x columns) and its products, nothing that grows with the rows.

* The next block is V Q less its part in the basis so far, orthogonalised twice against all of it (full reorthogonalisation).
* Columns that vanish then (breakdown: repeated eigenvalues, a space that is used up) are replaced by random directions orthogonal to
  the basis, so that no component is missed.
* Eigenpairs of the projection Q'VQ are accepted once their true residuals, known without a further pass, are small against the largest
  eigenvalue, or once the basis spans the whole space; a basis that outgrows its bound is restarted from its best Ritz vectors and the block
  that the last pass left over.

Entries c become whole numbers floor(256 c), so that sums are exact and repeats are equal.  The trace of V comes from exact deviations.

Defined results: vectors that are null, empty, or hold null, non-finite or unrepresentable entries (2^44 and more) are left out; so are those
of other lengths than the most frequent one (of ties, the least).  Components whose eigenvalue is not above rounding are left out, so a
table of one distinct vector, or none, gives no rows.  ``deviation`` is null where it exceeds 64 bits.  Rows with repeated or null ids
are kept.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilflow.llm.scratch import Scratch

SCALE, LARGEST = 256, float(2**44)


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and x of every vector that takes part, of whatever length."""
    wide = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.forall("wide", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = vectors.select(F.col(id_col).alias("vec_id"), wide.alias("wide")).where(F.col("wide").isNotNull() & (F.size("wide") > 0) & fine)
    return rows.select("vec_id", F.transform("wide", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all vectors of ``part`` of a batch: one row of numbers a task, added up by place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0))).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["place", "value"])

    out = np.zeros(size)
    for r in rows.select("x").mapInArrow(work, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():  # as many rows as numbers
        out[r["place"]] = r["value"]
    return out


@dataclass
class Whitener:
    """n fit vectors with sums S, leading eigenvalues of their covariance and unit eigenvectors (dimensions x components), its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = 8, most: int = 160, tol: float = 1e-12, passes: int = 200, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and unit eigenvectors of a symmetric positive operator that ``apply`` multiplies a block of columns by."""
    rng = np.random.default_rng(seed)
    block, k = min(d, max(block, k)), min(k, d)
    most = min(d, max(most, k + 2 * block))
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    want = rng.standard_normal((d, block))
    values, vectors = np.zeros(0), np.zeros((d, 0))
    for _ in range(passes):
        fresh = _orthonormal(want, basis, min(block, d - basis.shape[1]), rng)
        left = apply(fresh)
        basis, images = np.hstack([basis, fresh]), np.hstack([images, left])
        projected = basis.T @ images
        theta, s = np.linalg.eigh((projected + projected.T) / 2)
        order = np.argsort(theta)[::-1]
        theta, s = theta[order], s[:, order]
        values, vectors = theta[:k], basis @ s[:, :k]
        residuals = np.linalg.norm(images @ s[:, :k] - vectors * values, axis=0)
        # Where the basis is the whole space nothing is left to find.
        if basis.shape[1] >= d or np.all(residuals <= tol * max(theta[0], 0.0)):
            break
        want = left
        if basis.shape[1] + block > most:
            # Keep the best Ritz vectors; what the last pass led out of the basis goes on.
            want = left - basis @ (basis.T @ left)
            kept = s[:, : min(k + block, basis.shape[1])]
            basis, images = basis @ kept, images @ kept
    return values, vectors / np.linalg.norm(vectors, axis=0)


def _orthonormal(want: np.ndarray, basis: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n orthonormal columns orthogonal to ``basis``: what is new in ``want``, and random directions where it has nothing new."""
    out = np.zeros((len(want), 0))
    for j in range(n):
        v = want[:, j] if j < want.shape[1] else rng.standard_normal(len(want))
        while True:
            size, whole = np.linalg.norm(v), np.hstack([basis, out])
            for _ in range(2):
                v = v - whole @ (whole.T @ v)
            if (left := np.linalg.norm(v)) > 1e-10 * size and left > 0:
                break
            v = rng.standard_normal(len(want))
        v = v / left
        v = v - whole @ (whole.T @ v)
        out = np.hstack([out, (v / np.linalg.norm(v))[:, None]])
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums of (n x - S)^2, as whole numbers of any size."""
    far = max(int(np.abs(x).max(initial=0)) * n + max((abs(s) for s in sums), default=0), 1)
    if far * far * max(1, x.shape[1]) < 2**63:
        y = n * x.astype(np.int64) - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    return [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]


def fit_whitener(fit: DataFrame, k: int = 4) -> Whitener | None:
    """The whitener of distinct vectors ``x`` (whole numbers, one length); None where there are none."""
    d = fit.select(F.size("x").alias("d")).first()
    if d is None:
        return None
    d = d["d"]
    # Sums of up to 38 digits, by place; the counts of all places are the number of vectors.
    places = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).collect()
    sums, n = [0] * d, places[0]["n"]
    for r in places:
        sums[r["i"]] = int(r["s"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(_deviations(_matrix(b.column(0)), n, sums)) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([str(total)])], names=["total"])

    trace = sum(int(r["total"]) for r in fit.select("x").mapInArrow(spread, "total string").collect()) / n**3  # one number a task
    mean = np.array([s / n for s in sums])

    def apply(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = x - mean
            return y.T @ (y @ q)

        return _summed(fit, part, d * q.shape[1]).reshape(d, -1) / n

    values, vectors = block_lanczos(apply, d, k)
    real = values > max(trace, 0.0) * d * np.finfo(float).eps
    if not real.any():
        return None
    return Whitener(n, sums, values[real], vectors[:, real], trace)


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each vector and component (from 1): n, deviation, whitened, explained, identity_error; and the same x gives the same values."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = whole_vectors(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = T.StructType.fromDDL(RESULT)
    schema = T.StructType([T.StructField("vec_id", rows.schema["vec_id"].dataType), *schema.fields[1:]])
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == lengths["d"])
    fit = scratch.cut(rows.groupBy("x").agg(F.count("*").alias("n_rows")), "fit")
    model = fit_whitener(fit, k)
    if model is None:
        return spark.createDataFrame([], schema)
    m = len(model.values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = model.project(x)
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    sums = _summed(fit, moments, m * m + m)
    mean = sums[m * m :] / model.n
    error = float(np.abs(sums[: m * m].reshape(m, m) / model.n - np.outer(mean, mean) - np.eye(m)).max())
    explained = model.values / model.trace

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            dev = [v if v < 2**63 else None for v in _deviations(x, model.n, model.sums)]
            rows_of = np.repeat(np.arange(len(x)), m)
            number = np.tile(np.arange(m), len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows_of)), pa.array(number + 1, pa.int32()), pa.array(np.full(len(number), model.n), pa.int64()), pa.array(dev, pa.int64()).take(pa.array(rows_of)),
                    pa.array(model.project(x).ravel()), pa.array(explained[number]), pa.array(np.full(len(number), error)),
                ],
                names=schema.names,
            )

    return scratch.last(rows.mapInArrow(work, schema))
