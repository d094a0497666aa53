"""Random polynomials and matrices of polynomials as columns, a draw for each row's seed."""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import draws
from ..operators import ranks
from ..operators.polynomials import gcd
from .samplers import PolynomialSampler

#: A polynomial: its terms, from the first drawn to the last; coefficients are fractions, those of RR whole multiples of 2^-40.
POLYNOMIAL = "array<struct<exps:array<int>,num:long,den:long>>"
#: A draw lists the monomials up to its degree, so there may be so many at most.
MOST_MONOMIALS = 10_000


@dataclass(frozen=True)
class Drawn:
    """Columns by the bounds of a sampler; draws with fewer than min_terms terms are drawn again."""

    sampler: PolynomialSampler
    min_terms: int = 0

    def __post_init__(self):
        if self._total(self.sampler.max_degree) > MOST_MONOMIALS:
            raise ValueError(f"there are more than {MOST_MONOMIALS} monomials to draw from")

    def _total(self, degree: int) -> int:
        return ranks.monomials_below(len(self.sampler.variables), degree + 1)

    def coefficient(self, seed: Column, *purpose: Column | str | int) -> Column:
        """(num, den) from the sampler's field; without zero if it is strict."""
        s, kind = self.sampler, self.sampler.field.kind
        if kind == "GF":
            p = s.field.modulus
            num = draws.below(p - 1, seed, *purpose) + 1 if s.strict else draws.below(p, seed, *purpose)
        elif kind == "RR":
            num = F.round((2 * draws.unit(seed, *purpose) - 1) * s.max_coeff * 2.0**40).cast("long")
        else:
            num = draws.signed(s.max_coeff, seed, *purpose) if s.strict else draws.below(2 * s.max_coeff + 1, seed, *purpose) - s.max_coeff
        den = draws.below(s.max_coeff, seed, *purpose, "den") + 1 if kind == "QQ" else F.lit(1 << 40 if kind == "RR" else 1).cast("long")
        pair = F.struct(num.alias("num"), den.alias("den"))
        if kind not in ("QQ", "RR"):
            return pair
        div = lambda a, b: F.call_function("div", a, b)
        return draws.let(pair, lambda c: draws.let(gcd(c["num"], c["den"]), lambda d: F.struct(div(c["num"], d).alias("num"), div(c["den"], d).alias("den"))))

    def attempt(self, seed: Column) -> Column:
        """One draw: the polynomial, or null if it misses the sampler's conditions."""
        s, v = self.sampler, len(self.sampler.variables)
        degrees = list(range(s.min_degree, s.max_degree + 1)) if s.degree_sampling == "uniform" else [s.max_degree]
        by_degree = F.lit(None).cast(POLYNOMIAL)
        which = draws.below(len(degrees), seed, "degree")
        for i, degree in enumerate(degrees):
            by_degree = F.when(which == i, self._of_degree(seed, degree, v)).otherwise(by_degree)
        return by_degree

    def _of_degree(self, seed: Column, degree: int, v: int) -> Column:
        s, total = self.sampler, self._total(degree)
        bound = min(s.max_terms or min(5, total), total)
        count = (draws.below(bound, seed, "terms") + 1).cast("int") if s.term_sampling == "uniform" else F.lit(bound)
        size = lambda e: F.aggregate(e, F.lit(0), lambda a, x: a + x)
        own = lambda e, i: F.struct(e.alias("exps"), self.coefficient(seed, "coefficient", i).alias("c"))

        def with_lead(exps: Column) -> Column:
            if not (s.strict and degree):
                return exps
            lead = ranks.monomial(draws.below(comb(v + degree - 1, degree), seed, "top"), v, degree)
            return F.when(F.exists(exps, lambda e: size(e) == degree), exps).otherwise(F.concat(F.array(lead), F.slice(exps, F.lit(2), F.size(exps) - 1)))

        def checked(count: Column, exps: Column) -> Column:
            terms = F.transform(F.transform(exps, own), lambda t: F.struct(t["exps"].alias("exps"), t["c"]["num"].alias("num"), t["c"]["den"].alias("den")))
            return draws.let(F.filter(terms, lambda t: t["num"] != 0), lambda terms: F.when(fits(terms, count), terms))

        def fits(terms: Column, count: Column) -> Column:
            reached, enough = F.coalesce(F.array_max(F.transform(terms, lambda t: size(t["exps"]))), F.lit(-1)), F.size(terms) >= self.min_terms
            if s.strict:
                return enough & (reached == degree) & (F.size(terms) == count)
            return enough & F.when(F.size(terms) > 0, reached >= s.min_degree).otherwise(F.lit(not s.nonzero))

        items = F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long"))
        exps = lambda n: F.transform(draws.chosen(items, n, seed, "monomial"), lambda r: ranks.monomial_up_to(r, v, degree))
        return draws.let(count, lambda n: draws.let(exps(n), lambda e: checked(n, with_lead(e))))

    def polynomial(self, seed: Column) -> Column:
        """POLYNOMIAL of a seed (text): the first attempt that meets the conditions; an error if none of max_attempts does."""
        tries = F.sequence(F.lit(0), F.lit(self.sampler.max_attempts - 1))
        found = F.aggregate(tries, F.lit(None).cast(POLYNOMIAL), lambda done, k: F.when(done.isNotNull(), done).otherwise(self.attempt(F.concat_ws(":", seed, k.cast("string")))))
        return F.coalesce(found, F.raise_error(F.lit("no polynomial met the conditions")).cast(POLYNOMIAL))

    def matrix(self, seed: Column, rows: int, columns: int, density: float = 1.0, unimodular: bool = False) -> Column:
        """An array of rows of polynomials, each zero with probability 1 - density; unimodular ones have 1 on and 0 below the diagonal."""
        zero = F.array().cast(POLYNOMIAL)
        one = F.array(F.struct(F.array(*[F.lit(0)] * len(self.sampler.variables)).alias("exps"), F.lit(1).cast("long").alias("num"), F.lit(1).cast("long").alias("den")))

        def cell(i: int, j: int) -> Column:
            if unimodular and i >= j:
                return one if i == j else zero
            own = F.concat_ws(":", seed, F.lit(f"{i},{j}"))
            drawn = self.polynomial(own)
            return drawn if density >= 1 else F.when(draws.unit(own, "density") < density, drawn).otherwise(zero)

        return F.array(*(F.array(*(cell(i, j) for j in range(columns))) for i in range(rows)))


def univariate(seed: Column, drawn: Drawn, max_degree: int, terms: int) -> Column:
    """POLYNOMIAL in one variable whose degrees are drawn without repeats."""
    degrees = draws.chosen(F.sequence(F.lit(0).cast("long"), F.lit(max_degree).cast("long")), F.lit(min(terms, max_degree + 1)), seed, "degree")
    own = lambda d, i: F.struct(F.array(d.cast("int")).alias("exps"), drawn.coefficient(seed, "coefficient", i).alias("c"))
    return F.transform(F.transform(degrees, own), lambda t: F.struct(t["exps"].alias("exps"), t["c"]["num"].alias("num"), t["c"]["den"].alias("den")))
