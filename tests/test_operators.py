import random
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mathloom.functions.lexer import Lexer, NumberPolicy
from mathloom.functions.vocab import Vocab, range_tokens
from mathloom.operators import algebra, collate, metrics, polynomials, tensors, validate

X = ["x", "y"]


def poly(text):
    return algebra.parse(text, X)


def frame(spark, *polys):
    return spark.createDataFrame([(i, list(e), Decimal(int(c))) for i, p in enumerate(polys) for e, c in p.items()], "poly_id int, exps array<int>, coeff decimal(38,0)")


def back(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["poly_id"], {})[tuple(r["exps"])] = Fraction(int(r["coeff"]))
    return out


def test_relational_arithmetic(spark):
    a, b = poly("(x + y)^2 - 3"), poly("x - y + 1")
    assert back(polynomials.add(frame(spark, a), frame(spark, b))) == {0: algebra.plus(a, b)}
    assert back(polynomials.multiply(frame(spark, a), frame(spark, b))) == back(polynomials.multiply(frame(spark, b), frame(spark, a))) == {0: algebra.times(a, b)}
    assert polynomials.add(frame(spark, a), polynomials.negate(frame(spark, a))).count() == 0
    three = frame(spark, a, b, a).withColumns({"position": F.col("poly_id") + 1, "poly_id": F.lit(0)})
    assert back(polynomials.product(three, "poly_id", "position", 3)) == {0: algebra.times(algebra.times(a, b), a)}
    sums = polynomials.prefix_sums(three, "poly_id", "position").withColumn("poly_id", F.col("position"))
    assert back(sums) == {1: a, 2: algebra.plus(a, b), 3: algebra.plus(algebra.plus(a, b), a)}
    assert {int(r["coeff"]) for r in polynomials.normalise(frame(spark, poly("10*x - 3*y")), modulus=7).collect()} == {3, 4}


def test_text_forms(spark):
    p = poly("3*x^2*y - x + 7 - y^3")
    packed = polynomials.pack(frame(spark, p), order="grevlex")
    shown = packed.select(polynomials.to_text(F.col("terms"), X).alias("t")).first()[0]
    assert shown == algebra.show(p, X, "grevlex") == "3*x^2*y - y^3 - x + 7"
    terms = spark.createDataFrame([("-2/5*x**2*y + 3*x - 1/9",)], "t string").select(polynomials.parse_expanded(F.col("t"), X)).first()[0]
    assert {tuple(t["exps"]): Fraction(t["coeff"]) for t in terms} == poly("-2/5*x**2*y + 3*x - 1/9")
    assert packed.select(polynomials.packed_degree(F.col("terms"))).first()[0] == 3
    for bad in ("C E1", "C1 E1 + C2 E1 E2", "E1"):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "t string").select(polynomials.parse_ce(F.col("t"))).collect()
    assert back(polynomials.unpack(packed)) == {0: p}


polys = st.dictionaries(st.tuples(st.integers(0, 3), st.integers(0, 3)), st.fractions(-5, 5, max_denominator=4).filter(bool), max_size=4)


@settings(max_examples=100, deadline=None)
@given(polys, polys, polys)
def test_division(f, g, h):
    for order in ("lex", "grlex", "grevlex"):
        q, r = algebra.divide(f, [g, h], order)
        assert algebra.plus(algebra.plus(algebra.times(q[0], g), algebra.times(q[1], h)), r) == f
        heads = [algebra.lead(p, algebra.ORDERS[order]) for p in (g, h) if p]
        assert not any(algebra.divides(x, e) for x in heads for e in r)


@settings(max_examples=100, deadline=None)
@given(polys)
def test_text_round_trip(p):
    assert algebra.parse(algebra.show(p, X), X) == p


def test_groebner():
    basis = algebra.groebner([poly("x^2 + y"), poly("x*y - 1")], "lex")
    assert [algebra.show(g, X) for g in basis] == ["x + y^2", "y^3 + 1"] or all(algebra.divide(f, basis, "lex")[1] == {} for f in (poly("x^2 + y"), poly("x*y - 1")))
    for order in ("lex", "grevlex"):
        g = algebra.groebner([poly("x^2 - y"), poly("x^3 - x")], order)
        for a in (poly("x^2 - y"), poly("x^3 - x"), poly("(x^2 - y)*(x + y) + x^3 - x")):
            assert algebra.divide(a, g, order)[1] == {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=3), min_size=1, max_size=3), st.fractions(-3, 3, max_denominator=3).filter(bool))
def test_factors(parts, unit):
    p = {(0,): unit}
    for c in parts:
        p = algebra.times(p, {(k,): Fraction(x) for k, x in enumerate(c) if x})
    u, factors = algebra.factor(p)
    out = {(0,): u} if u else {}
    for f, n in factors:
        for _ in range(n):
            out = algebra.times(out, f)
    assert out == p
    if p:
        assert algebra.parse(algebra.show_factors(u, factors), ["x"]) == p


def test_factors_of_large_numbers():
    """Coefficients with many divisors, repeated factors, and factors that split modulo every prime."""
    parts = [algebra.parse(t, ["x"]) for t in ("720720*x^2 + 17*x - 360360", "55440*x^2 - 13*x + 720720", "27720*x^3 + x + 65521", "x^4 + 1")]
    p = algebra.times(parts[3], parts[3])
    for q in parts[:3]:
        p = algebra.times(p, q)
    unit, factors = algebra.factor(p)
    assert unit == 1 and sorted((len(f), n, str(f)) for f, n in factors) == sorted((len(q), 1 + (q is parts[3]), str(dict(sorted(q.items())))) for q in parts)


def test_known_factors():
    f = lambda t: algebra.show_factors(*algebra.factor(algebra.parse(t, ["x"])))
    assert f("x^2 - 14*x + 48") in ("(x - 8) * (x - 6)", "(x - 6) * (x - 8)") and f("5/3*x") == "(5/3) * x" and f("x^4 + 4") == "(x^2 - 2*x + 2) * (x^2 + 2*x + 2)" or f("x^4 + 4").count("(") == 2
    assert f("x^2 + 1") == "(x^2 + 1)" and f("7") == "7" and f("0") == "0"


def test_comparison_and_latex(spark):
    diff = {tuple(r["exps"]): r["state"] for r in polynomials.compare(frame(spark, poly("x^2 + 2*x + 1")), frame(spark, poly("x^2 + 3*x + y"))).collect()}
    assert diff == {(2, 0): "equal", (1, 0): "coeff_wrong", (0, 0): "missing", (0, 1): "extra"}
    marked = frame(spark, poly("3*x^2 - x - 5")).withColumn("struck", F.col("coeff") == 3)
    assert polynomials.latex(marked, X).first()["latex"] == r"\cancel{3 x^{2}} - x - 5"


def test_numbers(spark):
    assert [r[0] for r in polynomials.primes_below(spark, 30).orderBy("prime").collect()] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    rows = spark.createDataFrame([(n,) for n in (1, 2, 64, 97, 6630, 2**40, 3**20, 31 * 37)], "n long").select("n", polynomials.prime_factors(F.col("n"), [2, 3, 5, 7, 11, 13, 17, 29]).alias("f")).collect()
    got = {r["n"]: r["f"] for r in rows}
    assert got[1] == [] and got[64] == [2] * 6 and got[97] == [97] and got[6630] == [2, 3, 5, 13, 17] and got[2**40] == [2] * 40 and got[3**20] == [3] * 20 and got[31 * 37] == [1147]
    assert spark.range(1).select(polynomials.monomial_counts(3, 3)).first()[0] == [1, 3, 6, 10]
    assert polynomials.exponent_vectors(spark.range(2), 3, 2).count() == 12 and polynomials.exponent_vectors(spark.range(1), 1, 4).first()["exps"] == [4]


def test_eigenvector():
    v = algebra.dominant_eigenvector([[2, 0, 0], [0, -3, 0], [0, 0, 1]])
    assert v == pytest.approx([0, 1, 0])


def test_collation(spark):
    rows = spark.createDataFrame([(0, 0, [5, 6, 7], [1, 2]), (0, 1, [8], [1, 2, 3, 4]), (1, 2, [], [9])], "batch int, idx int, s array<int>, t array<int>")
    got = collate.collate(rows, "batch", "s", "t").orderBy("idx").collect()
    assert [r["input_ids"] for r in got] == [[5, 6, 7], [8, 0, 0], []] and [r["attention_mask"] for r in got] == [[1, 1, 1], [1, 0, 0], []]
    assert [r["decoder_input_ids"] for r in got] == [[1, 2, 0], [1, 2, 3], []] and [r["labels"] for r in got] == [[2, -100, -100], [2, 3, 4], []]
    assert [r["decoder_x"] for r in collate.pad_extra(rows.withColumn("target_x", F.col("s")), "batch", "target_x").orderBy("idx").collect()] == [[0, 5, 6, 7, 0], [0, 8, 0, 0, 0], [0, 0]]


def test_scores(spark):
    rows = spark.createDataFrame([([1, 2, 3], [1, 2, 3]), ([1, 9, 3], [1, 2, -100]), ([5], [-100])], "p array<int>, y array<int>")
    got = metrics.accuracy(rows, "p", "y").first()
    assert got["token_accuracy"] == pytest.approx(4 / 5) and got["success_rate"] == pytest.approx(1 / 3)
    assert tuple(metrics.accuracy(rows.limit(0), "p", "y").first()) == (0.0, 0.0)
    texts = spark.createDataFrame([(0, " a\n", "a"), (1, "b", "c"), (2, "d", "d")], "idx int, generated string, reference string")
    assert metrics.exact_match(texts).first()[0] == pytest.approx(2 / 3) and metrics.exact_match(texts.limit(0)).first()[0] == 0.0
    assert [r["idx"] for r in metrics.cases(texts, True, "idx", 5).collect()] == [2] and [r["idx"] for r in metrics.cases(texts, False, "idx", 1).collect()] == [0]
    assert tuple(metrics.evaluation(texts, 3).first())[1] == 3


def test_statistics(spark):
    empty = spark.createDataFrame([], "value double")
    assert tuple(metrics.describe(empty).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    row = spark.createDataFrame([([2.0, 4.0],), ([],)], "v array<double>").select(metrics.list_statistics(F.col("v")).alias("s")).collect()
    assert tuple(row[0]["s"]) == (2, 2.0, 4.0, 3.0, 1.0) and tuple(row[1]["s"]) == (0, 0.0, 0.0, 0.0, 0.0)
    factors = spark.createDataFrame([([("f", 2), ("g", 1)],)], "f array<struct<p:string,multiplicity:int>>").select(metrics.factor_statistics(F.col("f")).alias("s")).first()[0]
    assert tuple(factors) == (2, 3)
    df = spark.createDataFrame([({"a": {"m": 1.0}}, 0.5), ({"a": {"m": 3.0}}, 1.5), (None, 1.0)], "stats map<string,map<string,double>>, runtime double")
    report = metrics.report(df, "runtime", "stats", 6.0)
    assert report["num_samples"] == 3 and report["samples_per_second"] == 0.5 and report["a_stats"]["m"] == {"mean": 2.0, "std": 1.0, "min": 1.0, "max": 3.0} and metrics.report(df, "runtime", None, 0)["samples_per_second"] == 0.0


def test_validation(spark):
    lexer = Lexer.build(Vocab.build(range_tokens("", 0, 9) + ["+"]), NumberPolicy(False, 0, False))
    rows = spark.createDataFrame([("1 + 2", "3"), ("4 + 77", "@ b")], "problem string, answer string")
    with pytest.raises(ValueError, match="77, <unk>, b|<unk>, 77, b|77, b, <unk>|, "):
        validate.check_tokens(rows, lexer, "problem", "answer")
    validate.check_tokens(rows.limit(1), lexer, "problem", "answer")
    good = {"x^2 + 1/3*y - 7 | -x": True, "3.5": True, "2*x**3*y": True, "z": False, "x +": False, "||": False, "": False, "x | ": True, "xy": False}
    got = dict(map(tuple, spark.createDataFrame([(k,) for k in good], "t string").select("t", validate.pieces_are_formulas(F.col("t"), X)).collect()))
    assert got == good
    assert validate.variable_names("x", 3) == ["x0", "x1", "x2"]
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            validate.variable_names(bad)


def test_tensors(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], 1)], "v array<double>, p int")
    import math

    c0, s0, c1, s1 = math.cos(1), math.sin(1), math.cos(0.01), math.sin(0.01)
    assert row.select(tensors.rotary(F.col("v"), F.col("p"), 4)).first()[0] == pytest.approx([c0 - 3 * s0, 2 * c1 - 4 * s1, 3 * c0 + s0, 4 * c1 + 2 * s1])
    assert row.select(tensors.encode_positions("sinusoidal", F.col("v"), F.col("p"), 4)).first()[0] == pytest.approx([1 + s0, 2 + c0, 3 + s1, 4 + c1])
    assert row.select(tensors.encode_positions("none", F.col("v"), F.col("p"), 4)).first()[0] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        tensors.encode_positions("learned", F.col("v"), F.col("p"), 4)
    with pytest.raises(Exception, match="longer"):
        row.select(tensors.add_sinusoidal(F.col("v"), F.col("p"), 4, 1)).collect()
    table = spark.createDataFrame([(0, [1.0] * 4)], "pos int, weights array<double>")
    assert tensors.add_learned(row, "v", "p", table, 1).first()["v"] == [2, 3, 4, 5]
    plans = spark.createDataFrame([([1, 5],), ([5, 1],)], "p array<int>").select(tensors.greedy_plan(F.col("p"), 2, 1, 0)).collect()
    assert [r[0] for r in plans] == [[2, 1, 0], [2, 5, 1]]


def test_random_seeds_are_independent_of_order():
    assert random.Random(5).random() == random.Random(5).random()
