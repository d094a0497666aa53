"""Eigenvalues and eigenvectors of small symmetric matrices as columns, by cyclic Jacobi rotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.draws import let

#: Rounds over all places above the diagonal; errors shrink quadratically once they are small.
SWEEPS = 8


def _rotated(s: Column, n: int, p: int, q: int) -> Column:
    """The state (matrix a, vectors v, both row by row) after the rotation that makes a[p][q] zero."""
    at = lambda m, i, j: F.element_at(s[m], F.lit(i * n + j + 1))
    ratio = (at("a", q, q) - at("a", p, p)) / (2 * at("a", p, q))
    tangent = F.when(at("a", p, q) == 0, F.lit(0.0)).otherwise(F.when(ratio < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) / (F.abs(ratio) + F.sqrt(ratio * ratio + 1)))

    def turn(t: Column) -> Column:
        c = 1 / F.sqrt(t * t + 1)
        return let(F.struct(c.alias("c"), (t * c).alias("s")), apply)

    def apply(r: Column) -> Column:
        # columns p and q of both, then rows p and q of the matrix
        mixed = lambda m, i, j: r["c"] * at(m, i, p) - r["s"] * at(m, i, q) if j == p else r["s"] * at(m, i, p) + r["c"] * at(m, i, q) if j == q else at(m, i, j)
        columns = F.array(*(mixed("a", i, j) for i in range(n) for j in range(n)))

        def rows(b: Column) -> Column:
            cell = lambda i, j: F.element_at(b, F.lit(i * n + j + 1))
            return F.array(*(r["c"] * cell(p, j) - r["s"] * cell(q, j) if i == p else r["s"] * cell(p, j) + r["c"] * cell(q, j) if i == q else cell(i, j) for i in range(n) for j in range(n)))

        return F.struct(let(columns, rows).alias("a"), F.array(*(mixed("v", i, j) for i in range(n) for j in range(n))).alias("v"))

    return let(tangent, turn)


def eigen(matrix: Column, n: int) -> Column:
    """(value, vector) of a symmetric matrix (an array of rows) of order n, by falling value. Vectors have length 1 and a positive first
    entry other than 0; a null in the matrix gives null."""
    places = [(p, q) for p in range(n) for q in range(p + 1, n)]
    flat = F.transform(F.flatten(matrix), lambda x: x.cast("double"))
    identity = F.array(*(F.lit(float(i == j)) for i in range(n) for j in range(n)))

    def step(s: Column, k: Column) -> Column:
        out = s
        for place, (p, q) in enumerate(places):
            out = F.when(k % len(places) == place, _rotated(s, n, p, q)).otherwise(out)
        return out

    end = F.aggregate(F.sequence(F.lit(0), F.lit(SWEEPS * len(places) - 1)), F.struct(flat.alias("a"), identity.alias("v")), step) if places else F.struct(flat.alias("a"), identity.alias("v"))

    def pairs(s: Column) -> Column:
        vector = lambda j: F.array(*(F.element_at(s["v"], F.lit(i * n + j + 1)) for i in range(n)))
        found = F.array(*(F.struct((-F.element_at(s["a"], F.lit(j * n + j + 1))).alias("by"), vector(j).alias("vector")) for j in range(n)))
        first = lambda v: F.coalesce(F.get(F.filter(v, lambda x: F.abs(x) > 1e-12), F.lit(0)), F.lit(1.0))
        signed = lambda v: F.transform(v, lambda x: x * F.signum(first(v)))
        return F.transform(F.array_sort(found), lambda r: F.struct((-r["by"]).alias("value"), signed(r["vector"]).alias("vector")))

    return F.when(F.forall(flat, lambda x: x.isNotNull()), let(end, pairs))


def gram(matrix: Column, n: int) -> Column:
    """The transposed matrix times the matrix, both as arrays of rows with n columns."""
    cell = lambda i, j: F.aggregate(matrix, F.lit(0.0), lambda s, row: s + row[i].cast("double") * row[j].cast("double"))
    return F.array(*(F.array(*(cell(min(i, j), max(i, j)) for j in range(n))) for i in range(n)))


def dominant_eigenvector(matrix: Column, n: int) -> Column:
    """Eigenvector of the largest eigenvalue of the transposed matrix times the matrix."""
    return F.get(eigen(gram(matrix, n), n), F.lit(0))["vector"]
