"""Whitening of embeddings by a randomised range finder.

A random matrix of a few more columns than there are components to find is multiplied by the covariance in passes over all centred rows
(never forming the covariance itself) and made orthonormal after each. Rayleigh-Ritz on its columns gives components; their residuals
say whether they are eigenvectors to double precision. If they aren't after the last pass, the columns are extended to a basis of the
whole space, for which a single further pass is exact.

Entries are whole numbers (scaled and shifted embeddings), so sums are exact, and rows are centred on an integer before the small
rest of the mean is taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

COMPONENTS = 16
#: Columns beyond the components, and passes before the whole space is taken.
OVERSAMPLING, PASSES = 16, 4
#: Largest residual |Vu - eu| of a component, as a share of the largest eigenvalue.
RESIDUAL = 1e-12
#: An eigenvalue below this share of the largest one is a direction without spread, which can't be whitened.
FLAT = 1e-12
#: Rows that are multiplied at once.
_ROWS = 4096

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
_PARTIAL = "place int, sums array<double>"
_ARROW = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class Whitening:
    """What makes rows white: their number, exact sums, eigenvalues and components (a column each), and how far the fit list's
    covariance is from the identity afterwards."""

    n: int
    sums: list[int]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray
    identity_error: float
    expanded: bool


def whole(embedding: Column, scale: int, shift: int) -> Column:
    """Entries as whole numbers."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)


def usable(embedding: Column) -> Column:
    """Whether there is a vector, and neither null nor a number that isn't finite in it."""
    finite = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & (F.size(embedding) > 0), F.lit(False))


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for a in range(0, batch.num_rows, _ROWS):
            rows = batch.slice(a, _ROWS).column(column)
            yield np.asarray(rows.flatten(), np.int64).reshape(len(rows), -1)


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Whole number next below the mean and the rest, exact before it is rounded to a double."""
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def _pass(fit: DataFrame, n: int, sums: list[int], columns: np.ndarray, squares: bool = False) -> np.ndarray:
    """Of the centred rows X: X^T (X columns) / n, or with squares (X columns)^T (X columns) / n and below it the columns' means."""
    low, rest = _centre(n, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for x in _matrices(batches, 0):
            centred = (x - low) - rest
            projected = centred @ columns
            total = total + (np.vstack((projected.T @ projected, projected.sum(axis=0))) if squares else centred.T @ projected)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["place", "sums"])

    cells = fit.select("x").mapInArrow(run, _PARTIAL).select("place", F.posexplode("sums").alias("column", "sum"))
    out = np.zeros((columns.shape[1] + 1 if squares else columns.shape[0], columns.shape[1]))
    for place, column, total in cells.groupBy("place", "column").agg(F.sum("sum")).collect():  # a small matrix
        out[place, column] = total / n
    return out


def _sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    row = fit.agg(F.count(F.lit(1)), *(F.sum(F.col("x")[k].cast("decimal(20,0)")) for k in range(dimension))).first()
    return row[0], [int(s or 0) for s in row[1:]]


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residuals) of Rayleigh-Ritz on an orthonormal basis and its image, by falling value."""
    small = basis.T @ image
    values, turns = np.linalg.eigh((small + small.T) / 2)
    values, turns = values[::-1], turns[:, ::-1]
    vectors = basis @ turns
    return values, vectors, np.linalg.norm(image @ turns - vectors * values, axis=0)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = 0) -> Whitening | None:
    """Fitted to a table of distinct rows x (arrays of longs of one length), which is read once for the sums, once a pass and once
    for the check. None if it is empty. Drivers hold the sums and a square matrix of the dimension."""
    first = fit.first()
    if first is None:
        return None
    dimension = len(first["x"])
    n, sums = _sums(fit, dimension)
    spread = lambda columns: _pass(fit, n, sums, columns)
    width, wanted = min(components + oversampling, dimension), min(components, dimension)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, width)))[0]
    done, expanded = False, width == dimension
    for _ in range(1 if expanded else passes):
        image = spread(basis)
        values, vectors, residuals = _ritz(basis, image)
        done = bool((residuals[:wanted] <= RESIDUAL * max(values[0], 0)).all())
        if done:
            break
        basis = np.linalg.qr(image)[0]
    if not done and not expanded:
        # the directions outside of the basis come behind it, so that together they are the whole space
        basis = np.linalg.qr(np.hstack((basis, np.eye(dimension))))[0]
        values, vectors, _ = _ritz(basis, spread(basis))
        expanded = True
    # trace(V) as the sum of all eigenvalues if there are all, else by a pass over squares
    trace = float(values.sum()) if expanded else _trace(fit, n, sums)
    keep = values[:wanted] > FLAT * max(trace, 0.0)
    values, vectors = values[:wanted][keep], vectors[:, :wanted][:, keep]
    error = 0.0
    if len(values):
        moments = _pass(fit, n, sums, vectors / np.sqrt(values), squares=True)
        covariance = moments[:-1] - np.outer(moments[-1], moments[-1])
        error = float(np.abs(covariance - np.eye(len(values))).max())
    return Whitening(n, sums, trace, values, vectors, error, expanded)


def _trace(fit: DataFrame, n: int, sums: list[int]) -> float:
    low, rest = (F.array(*map(F.lit, x.tolist())) for x in _centre(n, sums))
    squares = F.aggregate(F.zip_with(F.zip_with("x", low, lambda a, b: (a - b).cast("double")), rest, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return fit.agg(F.sum(squares) / n).first()[0]


def _whitener(w: Whitening):
    low, rest = _centre(w.n, w.sums)
    remainder = np.array([s % w.n for s in w.sums], np.int64)
    turn = w.components / np.sqrt(w.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                (x,) = _matrices([part], 1)
                white = ((x - low) - rest) @ turn
                off = w.n * (x - low) - remainder
                limit = np.abs(off).max(initial=0)
                deviations = (off * off).sum(axis=1).tolist() if int(limit) ** 2 * off.shape[1] < 2**63 else [sum(v * v for v in row) for row in off.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviations, pa.int64()), pa.array(white.tolist(), pa.list_(pa.float64()))], schema=_ARROW)

    return run


def whitening(vectors: DataFrame, components: int = COMPONENTS, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding", oversampling: int = OVERSAMPLING, passes: int = PASSES) -> DataFrame:
    """One row for each remaining input row and component: vec_id, component (from 1), n (distinct vectors), deviation (sum over
    dimensions of (n x - S)^2, exact), whitened, explained (share of the trace), identity_error, eigenvalue.

    Entries c become x = floor(scale * c) + shift. Rows whose vector is null or empty or holds null, NaN or an infinity are dropped, and
    so are rows whose vector is shorter or longer than most (of lengths as frequent the larger counts). Repeated rows stay, but a
    vector counts once in the fit: equal ones are put together before they are shuffled. Components of equal eigenvalue are any orthonormal
    ones; directions without spread give no rows, so one distinct vector, or none, gives an empty table. A deviation beyond 63 bits is
    an error. A null id stays null; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c")).filter(usable(F.col("c")))
    lengths = rows.groupBy(F.size("c").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    empty = spark.createDataFrame([], SCHEMA)
    if lengths is None:
        return empty
    rows = rows.filter(F.size("c") == lengths["length"]).select("vec_id", whole(F.col("c"), scale, shift).alias("x"))
    fit = scratch.save(rows.select("x").distinct(), "fit")
    w = fit_whitening(fit, components, oversampling, passes)
    if w is None or not len(w.eigenvalues):
        return empty
    white = rows.mapInArrow(_whitener(w), "vec_id long, deviation long, whitened array<double>")
    values = F.array(*(F.lit(float(e)) for e in w.eigenvalues))
    long = white.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return long.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(w.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        (values[F.col("place")] / w.trace).alias("explained"),
        F.lit(w.identity_error).alias("identity_error"),
        values[F.col("place")].alias("eigenvalue"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
