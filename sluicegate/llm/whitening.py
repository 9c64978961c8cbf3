"""Whitening of vectors by Chebyshev-filtered subspace iteration.

Vectors become whole numbers x = floor(64 c) + 1000000; each distinct x counts once (the fit
list).  The leading eigenvectors of the fit list's covariance V are found without forming V: a
block Q of ``GUARD`` times as many columns as are wanted is multiplied by V in passes over the
centred rows, each pass a sum of partial products Xᵀ(XQ) over partitions.  A Chebyshev recurrence
of such products damps the spectrum below the block's smallest Ritz value, then QR and
Rayleigh-Ritz give new Ritz pairs, until the residuals of all wanted pairs are certified: below
``RESIDUAL`` times the largest eigenvalue.  A last pass measures the covariance of the whitened
fit list against the identity.

Rows take no part whose vector is null, holds a null, NaN or infinite entry, or has another length
than most vectors (of lengths equally common, the longest).  Equal vectors count once in the fit
and get equal rows.  Components of no variance (below ``RANK`` times the largest) are not
returned, so a fit list of one vector, and an empty table, give no rows.  Of components with the
same eigenvalue any orthonormal choice may be returned.  ``deviation`` is null where it exceeds a
long.  A null vec_id stays null; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm.base import table, written

COMPONENTS = 16
#: Columns of the block for each component wanted, and products with V in a filter.
GUARD, DEGREE = 3, 8
#: Certificate: residual of a pair against the largest eigenvalue; eigenvalues below RANK of it count as zero.
RESIDUAL, RANK = 1e-13, 1e-11
#: Rounds after which a block that is not certified is an error.
ROUNDS = 400
#: Numbers of the fit list that a task holds as doubles at a time.
SLICE = 1 << 20


def whole_numbers(vectors: DataFrame, id_column: str, column: str) -> tuple[DataFrame, int]:
    """(id, x array<long>) of the vectors that take part, and their dimension."""
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    valid = vectors.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & finite)
    sizes = valid.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    size = common["size"] if common else 0
    x = F.transform("v", lambda c: F.floor(c * 64) + F.lit(1000000).cast("long"))
    return valid.where(F.size("v") == size).select("id", x.alias("x")), size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _parts(batches, size: int):
    """Rows of the fit list, some at a time."""
    step = max(1, SLICE // size)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield _matrix(batch.column(0).slice(at, step), size)


def summed(fit: DataFrame, size: int, product, shape: tuple[int, int], kind: str = "double") -> np.ndarray:
    """The sum over the fit list of ``product(rows)``, an array of ``shape``.

    Each partition sums its own rows; Spark sums the partitions line by line, so the driver gets
    no more than one array.
    """
    def partial(batches):
        total = np.zeros(shape, np.int64 if kind == "long" else np.float64)
        for x in _parts(batches, size):
            total += product(x)
        lines = pa.array(list(total), pa.list_(pa.int64() if kind == "long" else pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), lines], ["line", "cells"])

    lines = fit.mapInArrow(partial, f"line long, cells array<{kind}>").groupBy("line").agg(
        F.array(*[F.sum(F.col("cells")[j]) for j in range(shape[1])]).alias("cells")).collect()
    out = np.zeros(shape, np.int64 if kind == "long" else np.float64)
    for line, cells in lines:
        out[line] = cells
    return out


@dataclass
class Fit:
    """Size and sums of the fit list, its leading components (columns) and eigenvalues."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0
    rounds: int = 0
    residual: float = 0.0


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, from a whole-number difference, so that nothing is lost to cancellation."""
    return (n * x - sums) / n


def chebyshev(times, q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """p(V) q for the Chebyshev polynomial that is small on [low, high], scaled to about 1 at ``top``;
    ``times`` multiplies by V and ``vq`` is V q."""
    centre, half = (high + low) / 2, (high - low) / 2
    first = sigma = half / (top - centre)
    x, y = q, (vq - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        x, y = y, (times(y) - centre * y) * (2 * following / half) - (sigma * following) * x
        sigma = following
    return y


def leading_pairs(times, size: int, wanted: int, seed: int = 11):
    """The ``wanted`` largest eigenpairs of the symmetric matrix behind ``times``: values, vectors,
    rounds taken, and the largest residual against the largest value."""
    block = min(size, GUARD * wanted)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, block)))[0]
    best, stalled = np.inf, 0
    for turn in range(1, ROUNDS + 1):
        vq = times(q)
        ritz = q.T @ vq
        values, turned = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        q, vq = q @ turned, vq @ turned
        top = values[0]
        if top <= 0:
            return values[:wanted], q[:, :wanted], turn, 0.0
        residual = float(np.linalg.norm(vq - q * values, axis=0)[:wanted].max() / top)
        # Rounding may keep the residual just above the limit: three rounds without gain end there.
        stalled = stalled + 1 if residual > 0.5 * best else 0
        best = min(best, residual)
        if residual <= RESIDUAL or (stalled >= 3 and residual <= 100 * RESIDUAL):
            return values[:wanted], q[:, :wanted], turn, residual
        high = max(values[-1], RANK * top)
        y = chebyshev(times, q, vq, 0.0, high, top, DEGREE)
        q = np.linalg.qr(np.linalg.qr(y)[0])[0]
    raise ArithmeticError(f"components not certified after {ROUNDS} rounds: residual {best:.1e}")


def fitted(fit: DataFrame, size: int, components: int = COMPONENTS) -> Fit:
    """Leading components of the distinct rows ``fit`` (one column x of whole numbers)."""
    head = summed(fit, size, lambda x: np.vstack([x.sum(axis=0), np.full(x.shape[1], len(x))]), (2, size), "long")
    sums, n = head[0], int(head[1][0]) if size else 0
    if n < 2:
        return Fit(n, sums, np.zeros((size, 0)), np.zeros(0), 0.0)

    def times(q: np.ndarray) -> np.ndarray:
        def product(x):
            c = centred(x, n, sums)
            return c.T @ (c @ q)

        return summed(fit, size, product, q.shape) / n

    trace = float(summed(fit, size, lambda x: (centred(x, n, sums) ** 2).sum(axis=0)[None], (1, size)).sum()) / n
    values, vectors, rounds, residual = leading_pairs(times, size, min(components, size))
    some = values > RANK * values[0]
    values, vectors = values[some], vectors[:, some]

    def covariance(x):
        w = centred(x, n, sums) @ vectors / np.sqrt(values)
        return w.T @ w

    many = len(values)
    error = float(np.abs(summed(fit, size, covariance, (many, many)) / n - np.eye(many)).max()) if many else 0.0
    return Fit(n, sums, vectors, values, trace, error, rounds, residual)


def _projected(model: Fit, size: int):
    many = len(model.values)
    step = max(1, SLICE // max(size, many))

    def project(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                ids = batch.column(0).slice(at, step)
                difference = model.n * _matrix(batch.column(1).slice(at, step), size) - model.sums
                rough = (difference.astype(np.float64) ** 2).sum(axis=1)
                deviation = pa.array((difference * difference).sum(axis=1), mask=rough > 9.2e18)
                whitened = (difference / model.n) @ model.vectors / np.sqrt(model.values)
                row = np.repeat(np.arange(len(ids)), many)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(ids))),
                     deviation.take(pa.array(row)), pa.array(whitened.reshape(-1)),
                     pa.array(np.tile(model.values / model.trace, len(ids)))],
                    ["id", "component", "deviation", "whitened", "explained"])

    return project


def whitened(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding",
             components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, size = whole_numbers(vectors, id_column, column)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, component int, deviation long, whitened double, explained double"
    model = None
    if size:
        # Copies are taken together before they are shuffled, so a common vector is no hot key.
        fit = written(rows.select("x").distinct(), "whitening-fit")
        model = fitted(fit, size, components)
    if model is None or not len(model.values):
        out = rows.where("false").select("id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("deviation"),
                                         F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"))
        model = model or Fit(0, np.zeros(0), np.zeros(0), np.zeros(0), 0.0)
    else:
        out = rows.mapInArrow(_projected(model, size), schema)
    return out.select(
        F.col("id").alias(id_column), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        "explained", F.lit(model.identity_error).alias("identity_error"))


def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_chebyshev_whitening": op11_chebyshev_whitening}
SQL: dict[str, str] = {}
