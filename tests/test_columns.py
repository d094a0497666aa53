"""What is parsed, ranked and drawn as columns, against plain Python."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from mathloom.functions import draws
from mathloom.operators import algebra, expressions, metrics, polynomials, ranks, spectra
from mathloom.plans import drawn, generate, samplers, tasks
from mathloom.sources import batches, scans

V = ["x", "y", "x1"]
FORMULAS = {
    "x/2": True, "(x+1)/2": True, "2*-x": True, "-x^2": True, "(-x)^2": True, "x**3": True, "2^3^1": True, "x^(2-1)": True, "+x": True, "--x": True, "1.5*x": True, "x1 + x": True, "2-3-4": True, "x/2/3": True, "(x+1)^0": True, "0*x": True,
    "x/(2-2)": False, "x/y": False, "x(": False, "x)": False, "((x)": False, "x y": False, "2x": False, "": False, "  ": False, "x^-1": False, "x^y": False, "x2": False, "x^1.5": False, "5 5": False, "x**": False, "x + * y": False, "()": False, "1.5.2": False, "x & y": False,
}


def test_formulas(spark):
    df = spark.createDataFrame([(t,) for t in FORMULAS] + [(None,)], "t string")
    got = dict(map(tuple, df.select("t", expressions.is_formula(F.col("t"), V)).collect()))
    assert got == FORMULAS | {None: False}
    rows = df.select("t", expressions.postfix(expressions.tokens(F.col("t"), V), V).alias("p")).collect()
    order = {r["t"]: r["p"] for r in rows}
    assert order["-x^2"] == ["x", "2", "^", "neg"] and order["2-3-4"] == ["2", "3", "-", "4", "-"] and order["2^3^1"] == ["2", "3", "1", "^", "^"] and order["x)"] is None


def formula(rng, depth):
    kind = rng.random()
    sub = lambda: formula(rng, depth - 1)
    if depth == 0 or kind < 0.25:
        return rng.choice(["x", "y", str(rng.randint(0, 9)), f"{rng.randint(1, 9)}/{rng.randint(1, 9)}"])
    return f"{sub()} + {sub()}" if kind < 0.5 else f"({sub()} - {sub()})" if kind < 0.65 else f"({sub()})*({sub()})" if kind < 0.85 else f"({sub()})^{rng.randint(0, 3)}" if kind < 0.95 else f"-({sub()})"


def test_expressions_are_expanded(spark):
    rng = random.Random(3)
    texts = [(formula(rng, 3),) for _ in range(200)]
    for r in spark.createDataFrame(texts, "t string").select("t", expressions.parse_expression(F.col("t"), ["x", "y"]).alias("p")).collect():
        assert {tuple(t["exps"]): Fraction(t["num"], t["den"]) for t in r["p"]} == algebra.parse(r["t"], ["x", "y"])
        assert [tuple(t["exps"]) for t in r["p"]] == sorted((tuple(t["exps"]) for t in r["p"]), reverse=True)


def test_ranks(spark):
    for n, k in ((6, 3), (5, 0), (4, 4), (1, 1)):
        total = len(list(filter(lambda s: bin(s).count("1") == k, range(1 << n))))
        rows = spark.range(total).select("id", ranks.combination(F.col("id"), n, k).alias("c")).collect()
        assert all(r["c"] == samplers.combination(r["id"], n, k) for r in rows) and len({tuple(r["c"]) for r in rows}) == total
    rows = spark.range(56).select("id", ranks.monomial_up_to(F.col("id"), 3, 5).alias("e")).collect()
    assert [sum(r["e"]) for r in rows] == sorted(sum(r["e"]) for r in rows) and len({tuple(r["e"]) for r in rows}) == 56
    with pytest.raises(Exception, match="out of bounds"):
        spark.range(1).select(ranks.combination(F.col("id") + 20, 6, 3)).collect()
    with pytest.raises(ValueError):
        ranks.combination(F.lit(0), 200, 100)


@pytest.mark.parametrize("ring", ["ZZ", "QQ", "GF(7)", "RR"])
@pytest.mark.parametrize("strict", [True, False])
def test_drawn_polynomials(spark, ring, strict):
    s = samplers.PolynomialSampler.of_ring(f"{ring}[x, y, z]", min_degree=1, max_degree=3, max_terms=4, max_coeff=6, strict=strict)
    p = drawn.Drawn(s).polynomial(F.concat(F.lit("a"), F.col("id")))
    rows = spark.range(150).select("id", p.alias("p")).collect()
    again = spark.range(150).repartition(3).select("id", p.alias("p")).collect()
    assert sorted(rows) == sorted(again)
    for r in rows:
        exps = [tuple(t["exps"]) for t in r["p"]]
        values = [Fraction(t["num"], t["den"]) for t in r["p"]]
        assert 1 <= len(exps) <= 4 and len(set(exps)) == len(exps) and 1 <= max(map(sum, exps)) <= 3 and all(len(e) == 3 and min(e) >= 0 for e in exps)
        assert all(v and (0 < v < 7 if ring == "GF(7)" else abs(v) <= 6) and t["den"] > 0 and v.denominator == t["den"] for v, t in zip(values, r["p"]))
        assert ring == "QQ" or ring == "RR" or all(t["den"] == 1 for t in r["p"])
    assert {max(sum(t["exps"]) for t in r["p"]) for r in rows} == {1, 2, 3} and {len(r["p"]) for r in rows} >= {1, 2, 3, 4}


def test_draws_that_never_fit_are_an_error(spark):
    with pytest.raises(Exception, match="no polynomial met"):
        s = samplers.PolynomialSampler(("x",), samplers.Field("GF", 2), 2, 2, 1, strict=False, degree_sampling="fixed", term_sampling="fixed", max_attempts=2)
        spark.range(200).select(drawn.Drawn(s).polynomial(F.col("id").cast("string"))).collect()
    with pytest.raises(ValueError):
        drawn.Drawn(samplers.PolynomialSampler(tuple("abcdefgh"), max_degree=20))


def test_draws_are_uniform(spark):
    rows = spark.range(6000).select(draws.below(6, F.col("id").cast("string"), "die").alias("n"), draws.unit(F.col("id").cast("string")).alias("u"), draws.signed(3, F.col("id").cast("string")).alias("s")).collect()
    for name, values in (("n", range(6)), ("s", (-3, -2, -1, 1, 2, 3))):
        counts = [sum(r[name] == v for r in rows) for v in values]
        assert sum(counts) == 6000 and all(800 < c < 1200 for c in counts)
    assert 0.48 < sum(r["u"] for r in rows) / 6000 < 0.52 and all(0 <= r["u"] < 1 for r in rows)


def test_batches(spark, tmp_path):
    t = batches.BatchTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        t.read()
    assert t.append(spark.range(5), "a") and not t.append(spark.range(7), "a") and t.append(spark.range(5, 6), "b")
    with pytest.raises(Exception, match="broken"):
        t.append(spark.range(9).select(F.raise_error(F.lit("broken")).cast("long").alias("id")), "c")
    assert sorted(r["id"] for r in t.read().collect()) == list(range(6)) and [tuple(r) for r in t.log().orderBy("number").select("batch", "rows").collect()] == [("a", 5), ("b", 1)]
    spark.range(3).write.parquet(str(tmp_path / "t" / "data" / "0-lost"))
    assert t.sweep() == 1 and t.read().count() == 6
    assert batches.BatchTable(spark, str(tmp_path / "t"), fresh=True).append(spark.range(2), "a") and t.read().count() == 2
    for bad in ("", "a/b", "../x"):
        with pytest.raises(ValueError):
            t.append(spark.range(1), bad)


def test_generation_in_batches_goes_on_where_it_was_stopped(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    stats = lambda p, a: {"problem": len(p)}
    instance = tasks.examples().get("gf17_addition")
    generate.append_batches(spark, instance, {"train": 100}, str(tmp_path / "d"), 40, statistics=stats)
    samples, states = generate.append_batches(spark, instance, {"train": 100, "test": 7}, str(tmp_path / "d"), 40, statistics=stats)
    whole = generate.generate(spark, instance, {"train": 100, "test": 7}, statistics=stats)
    key = lambda df: sorted(map(repr, df.select("tag", "sample_index", "seed", "problem", "answer").collect()))
    assert key(samples.read()) == key(whole) and samples.log().count() == states.log().count() == 4
    got = metrics.described(metrics.merged(states.read().filter("tag = 'train'"), "category", "metric"), "category", "metric").first()
    want = metrics.sample_statistics(whole.filter("tag = 'train'"), "stats").first()
    assert got["n"] == want["n"] == 100 and all(abs(got[k] - want[k]) < 1e-9 for k in ("mean", "std", "min", "max"))


def test_partial_statistics_far_from_zero(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") % 13 + 1e9).alias("value"))
    parts = None
    for b in range(5):
        own = metrics.partial(rows.filter(F.col("k") % 5 == b))
        parts = own if parts is None else parts.unionByName(own)
    got, want = metrics.described(metrics.merged(parts)).first(), metrics.describe(rows).first()
    assert got["n"] == 1000 and abs(got["std"] - want["std"]) < 1e-6 and abs(got["mean"] - want["mean"]) < 1e-6


def test_limits_over_lists_of_files(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).write_text(f"{name} # 1\n{name} # 2\n")
    assert [tuple(r) for r in scans.read_pairs(spark, [str(tmp_path / "b"), str(tmp_path / "a")], 3).collect()] == [("a", "1"), ("a", "2"), ("b", "1")]


def test_two_decimals_are_those_of_the_double(spark):
    from mathloom.functions.text import two_decimals

    rng = random.Random(2)
    values = [k / 8 - 20 for k in range(400)] + [k * 0.005 for k in range(-300, 2000)] + [rng.uniform(-1e6, 1e6) for _ in range(500)] + [rng.uniform(0, 1) * 10 ** -rng.randint(0, 12) for _ in range(300)] + [1e15 + 0.125, 2.675, 1.005, 0.995, 99.995, -0.001]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", two_decimals(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in rows] == [f"{r['v']:.2f}" for r in rows]


def test_factors_of_quartics(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        p = {(0,): Fraction(1)}
        while max(e[0] for e in p) < 4:
            left = 4 - max(e[0] for e in p)
            d = rng.randint(1, left)
            q = {(d,): Fraction(1)} | {(i,): Fraction(rng.randint(-6, 6)) for i in range(d)}
            p = algebra.times(p, {e: c for e, c in q.items() if c})
            if rng.random() < 0.3:
                break
        rows.append(([int(p.get((i,), 0)) for i in range(max(e[0] for e in p) + 1)],))
    for r in spark.createDataFrame(rows, "c array<long>").select("c", polynomials.monic_factors(F.col("c")).alias("f")).collect():
        _, want = algebra.factor({(i,): Fraction(c) for i, c in enumerate(r["c"]) if c})
        want = sorted([int(f.get((i,), 0)) for i in range(max(e[0] for e in f) + 1)] for f, n in want for _ in range(n))
        assert sorted(r["f"]) == want, r


def test_eigenvectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5):
        ms = [a + a.T for a in rng.normal(size=(20, n, n))] + [np.diag(np.arange(n) + 1.0), np.ones((n, n)), np.zeros((n, n))]
        rows = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(ms)], "i int, m array<array<double>>").select("i", spectra.eigen(F.col("m"), n).alias("e")).collect()
        for r in rows:
            m, values, vectors = ms[r["i"]], np.array([e["value"] for e in r["e"]]), np.array([e["vector"] for e in r["e"]]).T
            assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], atol=1e-9) and np.allclose(m @ vectors, vectors * values, atol=1e-9) and np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-9)
    m = rng.normal(size=(3, 3)).tolist()
    got = spark.createDataFrame([(m,)], "m array<array<double>>").select(spectra.dominant_eigenvector(F.col("m"), 3).alias("v")).first()["v"]
    assert np.allclose(got, algebra.dominant_eigenvector(m), atol=1e-9)


def test_sieve_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(polynomials, "SIEVE_BLOCK", 16)
    plain = lambda n: [p for p in range(2, n) if all(p % d for d in range(2, int(p**0.5) + 1))]
    for n in (2, 3, 5, 100, 1000):
        assert sorted(r[0] for r in polynomials.primes_below(spark, n).collect()) == plain(n)
    numbers = [2, 6, 97, 1024, 4717, 999 * 997, 1009 * 1013]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long")
    got = {r["n"]: r["primes"] for r in polynomials.prime_divisors(rows, "n").collect()}
    for n in numbers:
        divisors, root = [p for p in plain(1012) if n % p == 0], n**0.5
        assert {p for p in divisors if p <= root} <= set(got.get(n, [])) <= set(divisors)
        factors = spark.createDataFrame([(n, got.get(n, []))], "n long, p array<long>").select(polynomials.prime_factors(F.col("n"), F.col("p"))).first()[0]
        assert math.prod(factors) == n and all(p in plain(1014) for p in factors)
    with pytest.raises(ValueError):
        polynomials.prime_divisors(spark.createDataFrame([(10**13,)], "n long"), "n")


def test_reduction_forms():
    from mathloom.plans.reduction import reduced, reduction_step

    V2 = ["x", "y"]
    problem, answer = "x^2*y + x + 1 | x^2 - 1 | y^2 - x", "x + y + 1"
    assert reduced(problem, answer, V2, "grevlex", False) == (problem, answer)
    parts = reduced(problem, answer, V2, "grevlex", True)[1].split(" | ")
    assert parts == ["y", "0", "x + y + 1"]
    # no basis, and a remainder that doesn't belong to it: zeros
    assert reduced("x | x^2 - 1 | x - 2", "7", V2, "grevlex", True)[1] == "0 | 0 | 7"
    f, *basis = reduced(problem, answer, V2, "lex", True)[0].split(" | ")
    assert basis == ["x - y^2", "y^4 - 1"]
    with pytest.raises(ValueError):
        reduction_step(V2, "other")


def test_greatest_common_divisors(spark):
    rng = random.Random(6)
    fib = [1, 1]
    while fib[-1] + fib[-2] < 2**63:
        fib.append(fib[-1] + fib[-2])
    pairs = [(a, b) for a, b in zip(fib, fib[1:])] + [(b, a) for a, b in zip(fib, fib[1:])] + [(0, 0), (0, 7), (7, 0), (-4, 6), (2**62, 2**40), (2**63 - 1, 2**63 - 2)]
    pairs += [(rng.randrange(-(2 ** rng.randrange(1, 63)), 2**62), rng.randrange(2 ** rng.randrange(1, 63))) for _ in range(300)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", polynomials.gcd(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r["g"] == math.gcd(r["a"], r["b"]) for r in rows)
