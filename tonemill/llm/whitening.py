"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows form a tall matrix X that is never gathered. Each step does one
distributed pass with both products: ``p = X q`` row by row and, from the same
rows, ``g = Xᵀ p`` summed by Spark; only vectors of one entry a dimension reach
the driver. A left vector ``u`` is kept as the small ``w`` with ``u = X w``, so
full reorthogonalisation against all earlier left vectors needs just their
``Xᵀ u`` (kept) and ``g``; right vectors are reorthogonalised twice. The small
bidiagonal matrix's SVD gives components and deviations. The process goes on (a
vanished vector is followed by a fresh one orthogonal to all others) until the
wanted triplets have converged *and* the variance outside the space found is
less than the last of them, so that no component, a repeated one included, can
be missing; all dimensions at most.

Entries become whole numbers ``floor(scale * c) + SHIFT``. The fit list holds
every distinct vector once; it is written to the shared folder, so each pass
scans stored rows and a lost executor costs a part of one pass. Equal vectors
are merged in each task before the exchange. Sums and squares of whole numbers
are exact: in 64 bits where the sizes allow, else with Python's integers.

Defined cases: null vectors, empty ones and those with a null or non-finite
entry take no part; of vectors with different lengths only the commonest length
(of equally common ones the longest) does. Whole numbers saturate at ±2^52. A
``deviation`` beyond 64 bits is null. Directions without variance have no
components, so fewer rows than asked for come out, none when all vectors are
equal or the table is empty. Repeated ids and rows are whitened row by row; null
ids stay. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tonemill.llm.ragged import in_batches, written

SCALE = 64
SHIFT = 1_000_000
BOUND = 1 << 52
TINY = 1e-12
NO_VARIANCE = 1e-9  # of the largest deviation
SEED = 20260901
PLACES = StructType([StructField("place", IntegerType()), StructField("part", DoubleType())])


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``id`` and ``x`` (whole numbers) of the vectors that take part."""
    entries = F.col("v")
    finite = ~F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size("v") == (size["size"] if size else 0))
    bound = float(BOUND)
    number = lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-bound)), F.lit(bound))), F.lit(-BOUND)), F.lit(BOUND)) + SHIFT
    return rows.select("id", F.transform("v", number).alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow list column of equally long rows as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Centre:
    """Number of fitted vectors, and sum, least and largest entry a dimension."""

    def __init__(self, n: int, sums: list[int], least: list[int], most: list[int]):
        self.n, self.sums, self.dims = n, sums, len(sums)
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n / n for s in sums])
        farthest = [max(n * hi - s, s - n * lo) for s, lo, hi in zip(sums, least, most)]
        self.short = n * max(map(abs, [*least, *most]), default=0) < 1 << 62 and sum(f * f for f in farthest) < 1 << 63

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part is taken off exactly, then the fraction."""
        return (x - self.whole) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, in Python's integers where 64 bits
        may not do; None beyond 64 bits."""
        if self.short:
            d = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return [s if s < 1 << 63 else None for s in (d * d).sum(axis=1).tolist()]


def centre(fit: DataFrame) -> Centre:
    """Count and exact sums of the fit list in one pass."""
    places = fit.select(F.posexplode("x").alias("place", "x")).groupBy("place")
    rows = places.agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("place").collect()
    return Centre(rows[0]["n"] if rows else 0, [int(r["s"]) for r in rows], [r["lo"] for r in rows], [r["hi"] for r in rows])


def summed(fit: DataFrame, at: Centre, part, size: int) -> np.ndarray:
    """Sum over the fit list of ``part(centred rows)``, a vector of ``size``:
    added up in each task, then by Spark, place by place."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += part(at.rows(matrix(batch.column("x"), at.dims)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["place", "part"])

    out = np.zeros(size)
    for row in in_batches(fit, run, PLACES).groupBy("place").agg(F.sum("part").alias("part")).collect():
        out[row["place"]] = row["part"]
    return out


def bidiagonalise(product, dims: int, count: int, trace: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest singular values of X and their right vectors
    (columns). ``product(q)`` gives ``Xᵀ X q`` and the squared length of ``X q``;
    ``trace`` is the sum of all squares of X."""
    random = np.random.default_rng(SEED)
    right = np.zeros(dims)
    v, w, z = (np.zeros((dims, 0)) for _ in range(3))  # right vectors, left ones as X w, and Xᵀ of the left ones
    diagonal, above, scale = [], [0.0], np.sqrt(trace)
    while True:
        if not above[-1]:  # the space so far is closed: a fresh direction
            right = random.standard_normal(dims)
            right = orthogonal(right, v)
            right /= np.linalg.norm(right)
        v = np.column_stack([v, right])
        q = right - (above[-1] * w[:, -1] if above[-1] else 0)
        g, square = product(q)
        for _ in range(2):  # against all left vectors; their products with X q are wᵀ g
            along = w.T @ g
            q, g, square = q - w @ along, g - z @ along, square - along @ along
        alpha = np.sqrt(max(square, 0))
        q, g, alpha = (q / alpha, g / alpha, alpha) if alpha > TINY * scale else (0 * q, 0 * g, 0.0)
        w, z = np.column_stack([w, q]), np.column_stack([z, g])
        diagonal.append(alpha)
        rest = orthogonal(g - alpha * right, v)
        beta = np.linalg.norm(rest)
        beta = beta if beta > TINY * scale else 0.0
        left, values, vectors = np.linalg.svd(np.diag(diagonal) + np.diag(above[1:], 1))
        k, unseen = len(values), trace - (values ** 2).sum()
        converged = k >= count and np.all(beta * np.abs(left[-1, :count]) <= TINY * values[:count])
        if k == dims or unseen <= TINY ** 2 * trace or converged and unseen < values[count - 1] ** 2:
            return values[:count], (v @ vectors.T)[:, :count]
        above.append(beta)
        if beta:
            right = rest / beta


def orthogonal(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """``x`` less its parts along the columns of ``to``, taken off twice."""
    for _ in range(2):
        x = x - to @ (to.T @ x)
    return x


def principal(fit: DataFrame, at: Centre, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest eigenvalues of the covariance, their unit vectors as columns, and
    its trace. Directions without variance are left out."""

    def both(c: np.ndarray, q: np.ndarray) -> np.ndarray:
        p = c @ q
        return np.append(p @ c, p @ p)

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        out = summed(fit, at, lambda c: both(c, q), at.dims + 1)
        return out[:-1], out[-1]

    trace = summed(fit, at, lambda c: np.array([(c * c).sum()]), 1)[0] if at.n else 0.0
    if not trace:
        return np.zeros(0), np.zeros((at.dims, 0)), 0.0
    values, vectors = bidiagonalise(product, at.dims, min(components, at.dims), trace)
    real = values > NO_VARIANCE * values[0]
    return values[real] ** 2 / at.n, vectors[:, real], trace / at.n


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = SCALE) -> DataFrame:
    """One row per taking-part row and component: ``component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error`` (measured
    over the fit list in a pass of its own)."""
    rows = whole_vectors(df, id_col, vector_col, scale)
    fit = written(rows.select("x").distinct(), "fit")
    at = centre(fit)
    values, vectors, trace = principal(fit, at, components)
    k, turn = len(values), vectors / np.sqrt(values)
    covariance = summed(fit, at, lambda c: ((c @ turn).T @ (c @ turn)).ravel(), k * k).reshape(k, k) / max(at.n, 1)
    error = float(np.abs(covariance - np.eye(k)).max(initial=0.0))
    types = {"component": IntegerType(), "n": LongType(), "deviation": LongType(), "whitened": DoubleType(), "explained": DoubleType(), "identity_error": DoubleType()}
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), *(StructField(name, t) for name, t in types.items())])

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"), at.dims)
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, at.n)),
                pa.array(at.deviation(x), pa.int64()).take(each), pa.array((at.rows(x) @ turn).ravel()),
                pa.array(np.tile(values / trace, m)), pa.array(np.full(m * k, error)),
            ], names=schema.names)

    return in_batches(rows if k else rows.where("false"), run, schema)
