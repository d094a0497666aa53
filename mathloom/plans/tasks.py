"""Generators of the example tasks."""

from __future__ import annotations

import random
from fractions import Fraction
from math import prod

from ..operators import algebra
from .generate import Generators, seeded
from .samplers import Field, PolynomialSampler

PRIMES_BELOW_30 = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)


def running_sum(rng: random.Random, p: int = 17):
    """Three to six numbers and their running sums in a prime field."""
    xs = [rng.randrange(p) for _ in range(rng.randint(3, 6))]
    return [str(x) for x in xs], [str(sum(xs[: k + 1]) % p) for k in range(len(xs))]


def integer_factors(rng: random.Random):
    """A product of five distinct primes below 30 and its sorted factors."""
    found = sorted(rng.sample(PRIMES_BELOW_30, 5))
    return str(prod(found)), [str(x) for x in found]


def polynomial_sums(rng: random.Random):
    """Polynomials and their prefix sums."""
    sampler = PolynomialSampler(("x", "y"), Field("ZZ"), max_degree=3, max_terms=4, max_coeff=5)
    polys, sums = [sampler.draw(rng) for _ in range(rng.randint(2, 4))], []
    for p in polys:
        sums.append(algebra.plus(sums[-1] if sums else {}, p))
    show = lambda p: algebra.show(p, ["x", "y"])
    return [show(p) for p in polys], [show(p) for p in sums]


def _factored(rng: random.Random, field: Field):
    sampler = PolynomialSampler(("x",), field, min_degree=1, max_degree=2, max_terms=3, max_coeff=9, strict=False)
    out = {(0,): Fraction(1)}
    for _ in range(rng.randint(1, 3)):
        out = algebra.times(out, sampler.draw(rng))
    unit, factors = algebra.factor(out)
    return algebra.show(out, ["x"]), algebra.show_factors(unit, factors)


def integer_polynomial_factors(rng: random.Random):
    return _factored(rng, Field("ZZ"))


def rational_polynomial_factors(rng: random.Random):
    return _factored(rng, Field("QQ"))


def eigenvector(rng: random.Random, n: int = 3):
    """A positive semidefinite matrix, normal numbers times their transpose, and its dominant eigenvector, with two decimals."""
    a = [[rng.gauss(0, 1) for _ in range(n)] for _ in range(n)]
    m = [[sum(row[i] * row[j] for row in a) for j in range(n)] for i in range(n)]
    two = lambda x: f"{x:.2f}"
    return [[two(x) for x in row] for row in m], [two(x) for x in algebra.dominant_eigenvector(m)]


def reduction(rng: random.Random):
    """A polynomial with a Groebner basis of two generators, and its normal form; nothing where the ideal is everything."""
    sampler = PolynomialSampler(("x", "y"), Field("QQ"), min_degree=1, max_degree=2, max_terms=3, max_coeff=3)
    generators, f = [sampler.draw(rng), sampler.draw(rng)], sampler.draw(rng)
    if any(len(g) < 2 for g in generators):
        return None
    basis = algebra.groebner(generators)
    if any(not any(e) for g in basis for e in [algebra.lead(g, algebra.ORDERS["grevlex"])]):
        return None
    f = algebra.plus(f, algebra.times(sampler.draw(rng), basis[0]))
    show = lambda p: algebra.show(p, ["x", "y"], "grevlex")
    return [show(f), *map(show, basis)], show(algebra.divide(f, basis)[1])


def examples() -> Generators:
    out = Generators()
    for name, make in (("gf17_addition", running_sum), ("integer_factorization", integer_factors), ("polynomial_addition", polynomial_sums), ("integer_polynomial_factorization", integer_polynomial_factors), ("rational_polynomial_factorization", rational_polynomial_factors), ("eigvec_3x3", eigenvector), ("polynomial_reduction", reduction)):
        out.add(name, seeded(make))
    return out
