"""Combinations and monomials by their ranks, as columns: the combinatorial number system with a table of binomials."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.draws import let


def _table(values: list[int]) -> Column:
    if max(values, default=0) >= 1 << 63:
        raise ValueError("the numbers of combinations are beyond 64 bits")
    return F.array(*(F.lit(v).cast("long") for v in values))


def combination(rank: Column, n: int, k: int) -> Column:
    """The rank-th k-subset of 0 to n - 1 in lexicographic order, as an array of ints; an error for ranks out of bounds.

    Going up through 0 to n - 1, a member is skipped with all subsets that begin with it if there are no more of them than are left to skip.
    """
    if not 0 <= k <= n:
        raise ValueError("a subset has at most all members")
    # beginning with i, with `left` members to choose: (n - i - 1 over left - 1), at i * (k + 1) + left
    counts = _table([comb(n - i - 1, left - 1) if left else 0 for i in range(n) for left in range(k + 1)])
    start = F.struct(rank.cast("long").alias("rank"), F.lit(k).alias("left"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        here = F.element_at(counts, i * (k + 1) + s["left"] + 1)
        skip = F.struct((s["rank"] - here).alias("rank"), s["left"].alias("left"), s["out"].alias("out"))
        take = F.struct(s["rank"].alias("rank"), (s["left"] - 1).alias("left"), F.concat(s["out"], F.array(i)).alias("out"))
        return F.when(s["left"] == 0, s).when(s["rank"] >= here, skip).otherwise(take)

    members = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step)["out"] if n and k else F.array().cast("array<int>")
    return F.when(rank.between(0, comb(n, k) - 1), members).when(rank.isNotNull(), F.raise_error(F.lit("a rank is out of bounds")).cast("array<int>"))


def monomial(rank: Column, variables: int, degree: int) -> Column:
    """The rank-th exponent vector of a total degree: the bars among stars and bars are a combination, exponents the gaps between them."""
    last = degree + variables - 1
    bars = F.concat(F.array(F.lit(-1)), combination(rank, last, variables - 1), F.array(F.lit(last)))
    return let(bars, lambda b: F.zip_with(F.slice(b, 2, variables), F.slice(b, 1, variables), lambda high, low: high - low - 1))


def monomials_below(variables: int, degree: int) -> int:
    """Number of monomials of smaller degrees."""
    return sum(comb(variables + d - 1, d) for d in range(degree))


def monomial_up_to(rank: Column, variables: int, degree: int) -> Column:
    """The rank-th exponent vector of all up to a total degree, smaller degrees first."""
    out = F.lit(None).cast("array<int>")
    for d in reversed(range(degree + 1)):
        low = monomials_below(variables, d)
        out = F.when(rank < monomials_below(variables, d + 1), monomial(rank - low, variables, d)).otherwise(out)
    return out
