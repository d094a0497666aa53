import math

import numpy as np
import pytest

from mathloom.llm import whitening

DATA = "/root/testdata/sf0.01"


def plain(rows):
    """Rows of whole vectors by id -> what the query has to return, by exact sums and a full eigendecomposition."""
    fit = sorted(set(map(tuple, rows.values())))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[float(n * x[k] - sums[k]) / n for k in range(d)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    deviation = {i: sum((n * x[k] - sums[k]) ** 2 for k in range(d)) for i, x in rows.items()}
    white = {i: np.array([float(n * x[k] - sums[k]) / n for k in range(d)]) @ vectors[:, ::-1] for i, x in rows.items()}
    return n, values[::-1], deviation, white


def check(got, rows, components=16):
    n, values, deviation, white = plain(rows)
    seen = {}
    for r in got:
        seen.setdefault(r["vec_id"], {})[r["component"]] = r
    wanted = sum(v > 1e-9 * values[0] for v in values[:components])
    assert seen.keys() == rows.keys()
    signs = {}
    for i, own in seen.items():
        assert sorted(own) == list(range(1, wanted + 1))
        for k, r in own.items():
            assert (r["n"], r["deviation"]) == (n, deviation[i]) and r["identity_error"] < 1e-9
            assert math.isclose(r["explained"], values[k - 1] / values.sum(), rel_tol=1e-9)
            expected = white[i][k - 1] / values[k - 1] ** 0.5
            sign = signs.setdefault(k, 1 if expected * r["whitened"] >= 0 else -1) if abs(expected) > 1e-6 else signs.get(k, 1)
            assert abs(r["whitened"] * sign - expected) < 1e-6


def numbers(embedding):
    return tuple(math.floor(64 * float(c)) + 1_000_000 for c in embedding)


def test_query(spark):
    rows = {r["vec_id"]: numbers(r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect() if r["embedding"] is not None}
    check(whitening.op13_whitening(spark, DATA).collect(), rows)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, component string, x string").repartition(3)


def test_edges(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(200)]
    same = [(1000 + i, good[0][1]) for i in range(100)]
    bad = [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 5), (2003, [1.0, float("inf"), 0.0, 0.0, 0.0]), (2004, []), (2005, [1.0, 2.0]), (2006, [-float("inf")] * 5)]
    rows = [(i, e, 1, "a", "b") for i, e in good + same + bad]
    got = whitening.whitening(frame(spark, rows)).collect()
    check(got, {i: numbers(e) for i, e in good + same})
    assert whitening.whitening(frame(spark, [])).count() == 0
    assert whitening.whitening(frame(spark, [(1, None, 1, "a", "b")])).count() == 0
    assert whitening.whitening(frame(spark, [(1, [1.0, 2.0], 1, "a", "b"), (2, [1.0, 2.0], 1, "a", "b")])).count() == 0
    # a line in space: one component
    line = [(i, [i / 8, i / 4, 1.0], 1, "a", "b") for i in range(20)]
    check(whitening.whitening(frame(spark, line)).collect(), {i: numbers(e) for i, e, *_ in line})
    ids = whitening.whitening(frame(spark, [(None, [1.0, 2.0], 1, "a", "b"), (2, [3.0, 2.0], 1, "a", "b"), (2, [3.0, 2.0], 1, "a", "b")])).collect()
    assert sorted((r["vec_id"] or 0, abs(round(r["whitened"], 9))) for r in ids) == [(0, 1.0), (2, 1.0), (2, 1.0)]


@pytest.mark.parametrize("decay, expanded", [(0.2, False), (0.97, True)])
def test_range_finder_and_expansion(spark, decay, expanded):
    """Steep spectra end with the random columns; flat ones need the whole space. Both give the same as a full decomposition."""
    rng = np.random.default_rng(7)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    x = (rng.normal(size=(600, 40)) * 1e9 * decay ** np.arange(40)) @ turn
    rows = {i: tuple(int(v) for v in row) for i, row in enumerate(x)}
    fit = spark.createDataFrame([(list(r),) for r in rows.values()], "x array<long>").repartition(4)
    w = whitening.fit_whitening(fit, components=4, oversampling=8, passes=6)
    n, values, _, _ = plain(rows)
    assert w.expanded is expanded and w.n == n and w.identity_error < 1e-9
    assert np.allclose(w.eigenvalues, values[:4], rtol=1e-10, atol=0) and math.isclose(w.trace, values.sum(), rel_tol=1e-10)
